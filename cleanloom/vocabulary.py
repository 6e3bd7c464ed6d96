"""Vocabularies, header keywords, patterns and presets that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# Texts that stand for a missing value (compared in lower case, trimmed).
MISSING_VALUES = (
    "", "unknown", "na", "n/a", "none", "null", "nan", "nat", "#n/a", "-", "--", "?", "missing", "not available", "undefined", "not specified", "not provided", "not found",
    "not applicable", "no data", "no value", "empty", "n.a", "n.a.", "nil", "void", "blank",
    "غير معروف", "غير معرف", "غير محدد", "لا يوجد", "مفقود", "غير متاح", "غير موجود", "غير مدرج", "غير معرّف", "لا شيء", "فارغ", "غير مكتمل",
)
# Missing terms of the statistical imputers.
IMPUTATION_MISSING = (
    "", "na", "n/a", "n\\a", "nan", "none", "null", "unknown", "missing", "not available", "not applicable", "غير محدد", "غير متوفر", "ناقص", "بدون", "لا يوجد", "ليس متاح",
)
# Texts that numeric columns lose before export.
EXPORT_MISSING = ("غير محدد", "غير متوفر", "N/A", "null", "NULL")
# Terms of the placeholder pattern (regular expressions).
PLACEHOLDER_TERMS = ("nan", "unknown", "null", "none", "n/?a", r"n\.?.a\.?", "missing", "not available", "ناقص", r"غير\s+محدد", r"غير\s+متوفر", r"بيانات\s+ناقصة")
# What the reader turns into null.
READER_NA = ("", "nan", "NaN", "NaT", "None", "none", "null", "NULL", "N/A", "n/a", "#N/A", "NA")
# Encodings a reader tries, in this order.
READER_ENCODINGS = ("utf-8", "utf-8-sig", "cp1256", "windows-1256", "iso-8859-6", "latin-1")
# Fixed value: fills text that stays missing.
SENTINEL = "غير محدد"

# Digits and what they become.
ARABIC_DIGITS, WESTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"

# Country codes with the least and the greatest length of a number that starts with them.
COUNTRY_LENGTHS = {
    "+20": (12, 13), "+966": (12, 13), "+971": (12, 13), "+965": (11, 12), "+974": (11, 12), "+973": (12, 13), "+968": (11, 12), "+962": (12, 13), "+964": (13, 14), "+961": (10, 11),
    "+963": (12, 13), "+970": (12, 13), "+967": (12, 13), "+249": (12, 13), "+218": (12, 13), "+216": (12, 13), "+213": (12, 13), "+212": (12, 13), "+222": (12, 13),
}
# Header keywords.
PHONE_HEADERS = ("phone", "tel", "mobile", "رقم", "تليفون", "الهاتف", "cellular", "number", "هاتف", "جوال", "نقال", "mob", "cell", "phone_no", "phone_num")
DATE_HEADERS = (
    "date", "تاريخ", "يوم", "day", "time", "وقت", "created", "updated", "birth", "ميلاد", "انشاء", "اضافة", "تعديل", "انتهاء", "بداية", "نهاية", "timestamp", "recorded",
    "created_at", "updated_at", "birth_date", "registration", "تسجيل", "order_date", "تاريخ_الطلب",
)
POLISH_DATE_HEADERS = ("date", "time", "تاريخ", "وقت", "day", "month", "year")
ID_HEADERS = ("id", "order id", "orderid", "order_no", "order no", "order number", "رقم", "رقم الطلب", "رقم الطلبية", "كود", "sku", "barcode", "token", "code", "uid", "user id")
NAME_HEADERS = ("name", "full_name", "fullname", "customer", "client", "company", "organisation", "organization", "person", "contact", "اسم", "الاسم", "اسم_الكامل", "اسم العميل", "شركة", "اسم_الشركة", "زبون")
DESCRIPTIVE_HEADERS = ("description", "notes", "comments", "text", "detail", "info", "remarks", "details", "summary", "content", "message", "وصف", "ملاحظات", "تعليقات", "تفاصيل", "معلومات")
FINANCIAL_HEADERS = (
    "price", "amount", "total", "cost", "fee", "tax", "value", "balance", "sum", "subtotal", "net", "gross", "paid", "charge", "invoice", "discount", "salary", "commission", "budget",
    "سعر", "مبلغ", "تكلفة", "قيمة", "إجمالي", "المجموع", "رصيد", "دفع", "فاتورة", "ضريبة", "رسوم", "صاف", "دفعة",
)
# Headers of grouping columns, by priority.
FINE_GUIDES = ("item name", "product name", "item", "product", "sku", "variant", "model", "item_id", "product_id", "title")
COARSE_GUIDES = ("category", "department", "segment", "group", "type", "class", "family", "category name", "department name")

# Currency signs and words that numbers lose.
CURRENCY_SIGNS = r"[\$€¥£]"
CURRENCY_WORDS = (
    "USD", "EGP", "SAR", "AED", "KWD", "QAR", "OMR", "BHD", "JOD", "LBP", "IQD", "MAD", "TND", "DZD", "LYD", "SDG", "YER", "SYP", "PLE", "MRU", "EUR", "GBP", "CNY", "JPY",
    r"ج\.م", r"ج\s*\.\s*م", "ريال", "درهم", "دينار", "جنيه", "ليرة", " pound", " dollar", " euro", " dirham", " riyal",
)
NUMERIC_JUNK = r"[^\d\.\-KMBkmb%]"

# Date formats, tried in this order (one-letter fields take one digit or two).
DATE_FORMATS = (
    "y-M-d", "d/M/y", "M/d/y", "d-M-y", "y/M/d", "d.M.y", "d M y", "y M d", "d/M/yy", "M/d/yy", "y-M-d H:m:s", "d/M/y H:m:s", "y-M-d'T'H:m:s", "d-M-y H:m:s", "MMMM d, y", "MMM d, y", "d MMMM y", "d MMM y",
)
# Arabic names of months.
ARABIC_MONTHS = {
    "يناير": 1, "كانون الثاني": 1, "فبراير": 2, "شباط": 2, "مارس": 3, "آذار": 3, "أبريل": 4, "ابريل": 4, "نيسان": 4, "مايو": 5, "أيار": 5, "ايار": 5, "يونيو": 6, "يونية": 6, "حزيران": 6,
    "يوليو": 7, "يولية": 7, "تموز": 7, "أغسطس": 8, "اغسطس": 8, "آب": 8, "سبتمبر": 9, "أيلول": 9, "ايلول": 9, "أكتوبر": 10, "اكتوبر": 10, "تشرين الأول": 10, "تشرين الاول": 10,
    "نوفمبر": 11, "تشرين الثاني": 11, "ديسمبر": 12, "كانون الأول": 12, "كانون الاول": 12,
}
EXCEL_EPOCH, EXCEL_LAST = "1899-12-30", 2_958_465

# Patterns of personal data and scripts.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^\+?[0-9][0-9\s\-()]{6,18}[0-9]$"
ARABIC = r"[\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF]"
ENGLISH = r"[A-Za-z]"
NUMBER = r"^[-+]?\d*\.?\d+$"
# Booleans as text.
BOOLEANS = {"true": "True", "false": "False", "yes": "True", "no": "False", "1": "True", "0": "False", "نعم": "True", "لا": "False"}
# English contractions, expanded in this order.
CONTRACTIONS = {"can't": "cannot", "won't": "will not", "n't": " not", "'re": " are", "'s": " is", "'d": " would", "'ll": " will", "'ve": " have", "'m": " am", "w/": " with ", "w/o": " without "}
# Marks and characters that text loses.
DIACRITICS = r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06ED]"
ZERO_WIDTH = r"[\u200c\u200d\u200e\u200f\uFEFF]"
CONTROLS = r"[\x00-\x1f\x7f]"

# Thresholds.
HIGH_MISSING, LOW_VARIANCE = 0.90, 0.98
IQR_FACTOR, IQR_LEAST_VALUES = 1.5, 4


@dataclass(frozen=True)
class ClusteringConfig:
    fuzzy_threshold: int
    max_unique_values: int
    min_unique_values: int = 2
    description: str = ""


# Presets of clustering.
PRESETS = {
    "STRICT": ClusteringConfig(95, 300, 2, "few false positives: categories and brands"),
    "BALANCED": ClusteringConfig(90, 500, 2, "the default"),
    "PERMISSIVE": ClusteringConfig(82, 500, 2, "noisy values that users typed"),
    "ARABIC_OPTIMIZED": ClusteringConfig(90, 300, 2, "Arabic, or Arabic and English"),
    "HIGH_CARDINALITY_PROTECTION": ClusteringConfig(90, 100, 3, "small domains only"),
    "AGGRESSIVE": ClusteringConfig(75, 500, 2, "very noisy data"),
    "PRODUCTION": ClusteringConfig(92, 200, 2, "critical pipelines"),
}
# Presets by where data come from.
RECOMMENDED = {"user_input": "PERMISSIVE", "manual_entry": "PERMISSIVE", "ocr": "AGGRESSIVE", "database": "PRODUCTION", "api": "BALANCED", "mixed": "BALANCED", "arabic": "ARABIC_OPTIMIZED", "production": "PRODUCTION"}


def preset(scenario: str) -> ClusteringConfig:
    return PRESETS.get(scenario.upper(), PRESETS["BALANCED"])


def recommended(data_source: str) -> ClusteringConfig:
    return PRESETS[RECOMMENDED.get(data_source.lower(), "BALANCED")]
