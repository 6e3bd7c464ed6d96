"""Fuzzy harmonisation. Only distinct values are compared, never rows.

Where a function has a bound of distinct values (max_unique, a preset's), it also bounds what reaches the driver: the values with
their counts. The leader rule is greedy and so depends on order; it runs there, with scores from the functions below. Token sets,
the majority, names and phones have no bound: all their distinct values are scored, in distributed passes, and the driver gets those
that are mapped; of token sets only the leaders and the values among which it finds them.
"""

from __future__ import annotations

import difflib
import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from .. import vocabulary as V
from ..functions import text as T
from . import detect, rows
from .rows import quoted
from .headers import any_header

MAPPING = "column string, old_value string, new_value string, method string, score double"


# Scores, 0 to 100, by their published definitions.


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * common_length(a, b) / total


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join(filter(None, [both, " ".join(sorted(z))])) for z in (x - y, y - x))
    if both and (x <= y or y <= x):
        return 100.0
    return max(ratio(one, two), *((ratio(both, one), ratio(both, two)) if both else (0.0, 0.0)))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter one with a window of the longer one of its length, windows at the ends being shorter."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return 100.0 if not b else 0.0
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)))


def weighted_ratio(a: str, b: str) -> float:
    """The plain ratio, token ratios at 0.95, and for very unlike lengths partial ratios at 0.9 (0.6 beyond eight times)."""
    if not a or not b:
        return 0.0
    unlike = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if unlike < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if unlike <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), scale * 0.95 * partial_token_ratio(a, b))


def sequence_ratio(a: str, b: str) -> float:
    return 100.0 * difflib.SequenceMatcher(None, a, b).ratio()


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


# Clusters.


def greedy(values: Sequence[str], alike: Callable[[str, str], float | None]) -> list[list[tuple[str, float | None]]]:
    """Clusters in the order of their leaders; each value joins the first leader that it is alike to."""
    clusters: list[list[tuple[str, float | None]]] = []
    for v in values:
        for c in clusters:
            score = alike(c[0][0], v)
            if score is not None:
                c.append((v, score))
                break
        else:
            clusters.append([(v, None)])
    return clusters


@any_header
def spellings(df: DataFrame, columns: Sequence[str], normalise: Callable | None = None) -> DataFrame:
    """column, value, form, n: the filled spellings of columns, their normal forms, how many rows have them."""
    form = T.strip(normalise(F.col("value")) if normalise else F.col("value"))
    return rows.cells(df, [], columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).select("column", "value", form.alias("form"), "n").where("form <> ''")


@any_header
def token_set_mapping(df: DataFrame, columns: Sequence[str], threshold: float = 90, max_unique: int | None = None, normalise: Callable | None = None) -> list[tuple]:
    """token_set_found as rows on the driver."""
    return sorted(tuple(r) for r in token_set_found(df, columns, threshold, max_unique, normalise).collect())


@any_header
def token_set_found(df: DataFrame, columns: Sequence[str], threshold: float = 90, max_unique: int | None = None, normalise: Callable | None = None) -> DataFrame:
    """A table of MAPPING: leaders by the frequency of forms; the canonical value is the most frequent spelling of its cluster (ties: the smallest).

    All columns go through the same few jobs. With max_unique, only so many spellings of each, the most frequent, take part.
    """
    if not columns:
        return mapping_frame(df, [])
    spelt = spellings(df, columns, normalise)
    if max_unique:
        spelt = rows.union_all([spelt.where(F.col("column") == c).orderBy(F.desc("n"), "value").limit(max_unique) for c in columns])
    spelt = tables.written(spelt, "spellings")
    forms = tables.written(spelt.groupBy("column", F.col("form").alias("value")).agg(F.sum("n").alias("n")), "forms")
    few = _few(forms)
    if few is None:
        led = tables.written(_led(forms, token_set_leaders(forms, threshold), threshold), "led")
    else:
        led = F.broadcast(tables.local(df.sparkSession, _led_rows(((r["column"], r["value"]) for r in few), _few_leaders(few, threshold), threshold), LED))
    led = spelt.join(led, ["column", "form"])
    master = led.groupBy("column", "leader").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("master"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    found = led.join(master, ["column", "leader"]).where("value <> master")
    return tables.written(found.select("column", F.col("value").alias("old_value"), F.col("master").alias("new_value"), F.lit("token_set").alias("method"), "score"), "spellings-found")


def _without(s: str, k: int) -> set[str]:
    """What can be left of s when k of its letters are deleted."""
    if k == 1:
        return {s[:i] + s[i + 1 :] for i in range(len(s))}
    return set(map("".join, itertools.combinations(s, len(s) - k))) if k else {s}


class TokenSetLeaders:
    """Leaders in their order, and the first that a value is alike to: the one that scoring all in turn would find.

    Only those are scored that can reach the threshold. Of two alike values, either the tokens that they share are nearly all of one
    of them, and one of its rarest tokens is shared; or their tokens in the score's order have a common subsequence of known length,
    and deleting as many letters as may differ leaves something equal: of single tokens the text, of others their letters in
    alphabetical order. Where that makes too many texts, letters are counted: the common subsequence can't be longer than the letters
    in common.
    """

    #: Texts of one value, and of all leaders of one length, up to which they are looked up.
    MOST, MOST_IN_ALL = 500, 2_000_000

    def __init__(self, threshold: float, near: Iterable[str] = ()) -> None:
        """near: values whose tokens tell which are rare. That is for speed alone."""
        self.threshold, self.values = threshold, []
        self.share = 1.0 if threshold >= 100 else threshold / (200 - threshold)
        self.frequency = Counter(w for v in near for w in set(v.split()))
        self.by_rare: dict[str, list[int]] = {}
        self.by_other: dict[str, list[int]] = {}
        self.lengths: dict[tuple[bool, int], list[int]] = {}
        self.texts: dict[tuple[bool, int], dict[tuple[bool, int], dict | None]] = {}
        self.counts: dict[tuple[bool, int], list] = {}
        self.least: dict[int, int] = {}

    def add(self, value: str) -> None:
        rank, tokens = len(self.values), set(value.split())
        self.values.append(value)
        if not tokens:
            return
        whole = " ".join(sorted(tokens))
        kind = len(tokens) == 1, len(whole)
        rare = self._rarest(tokens, len(whole))
        for w in rare:
            self.by_rare.setdefault(w, []).append(rank)
        for w in tokens.difference(rare):
            self.by_other.setdefault(w, []).append(rank)
        self.lengths.setdefault(kind, []).append(rank)
        for own, known in self.texts.get(kind, {}).items():
            if known is not None:
                self._enter(kind, own, rank, whole)
        if kind in self.counts:
            self._count(kind, whole)

    def first(self, value: str) -> tuple[int, float] | None:
        """Rank and score of the first leader."""
        ranks = self._possible(set(value.split())) if self.threshold > 0 else range(len(self.values))
        for r in sorted(ranks):
            score = token_set_ratio(self.values[r], value)
            if score >= self.threshold:
                return r, score
        return None

    def _possible(self, tokens: set[str]) -> set[int]:
        ranks: set[int] = set()
        if not tokens:
            return ranks
        whole = " ".join(sorted(tokens))
        size, single = len(whole), len(tokens) == 1
        for w in tokens:
            ranks.update(self.by_rare.get(w, ()))
        for w in self._rarest(tokens, size):
            ranks.update(self.by_other.get(w, ()))
        for kind in self.lengths:
            least = self._least(size + kind[1])
            mine, others = size - least, kind[1] - least
            if mine < 0 or others < 0:
                continue
            known, plain = None, single and kind[0]
            if math.comb(size, mine) <= self.MOST and math.comb(kind[1], others) <= self.MOST:
                known = self._texts(kind, (plain, others))
            if known is None:
                ranks.update(self._by_counts(kind, whole, least))
            elif plain:  # surely alike, so only the first counts
                ranks.update(known[t] for t in _without(whole, mine) if t in known)
            else:
                for t in _without("".join(sorted(whole)), mine):
                    ranks.update(known.get(t, ()))
        return ranks

    def _rarest(self, tokens: set[str], size: int) -> list[str]:
        """So many of the rarest tokens that without any of them the rest is too little of the whole."""
        if len(tokens) == 1:
            return [*tokens]
        out, left = [], (1 - self.share) * size + 1e-6
        for w in sorted(tokens, key=lambda w: (self.frequency[w], -len(w), w)):
            out.append(w)
            left -= len(w) + 1
            if left < 0:
                break
        return out

    def _least(self, total: int) -> int:
        """The shortest common subsequence whose ratio reaches the threshold."""
        if total not in self.least:
            c = max(0, math.ceil(self.threshold * total / 200) - 2)
            while 200.0 * c / total < self.threshold:
                c += 1
            self.least[total] = c
        return self.least[total]

    def _whole(self, rank: int) -> str:
        return " ".join(sorted(set(self.values[rank].split())))

    def _texts(self, kind: tuple[bool, int], own: tuple[bool, int]) -> dict | None:
        mine = self.texts.setdefault(kind, {})
        if own not in mine:
            mine[own] = {}
            for r in self.lengths[kind]:
                if mine[own] is not None:
                    self._enter(kind, own, r, self._whole(r))
        return mine[own]

    def _enter(self, kind: tuple[bool, int], own: tuple[bool, int], rank: int, whole: str) -> None:
        plain, others = own
        known = self.texts[kind][own]
        for t in _without(whole if plain else "".join(sorted(whole)), others):
            if plain:
                known.setdefault(t, rank)
            else:
                known.setdefault(t, []).append(rank)
        if len(known) > self.MOST_IN_ALL:
            self.texts[kind][own] = None

    @staticmethod
    def _letters(whole: str, kind: tuple[bool, int]):
        """Counts of letters by the last bits of their codes. Leaders' counts are at most their length, so greater ones needn't be told apart."""
        import numpy as np

        counts = np.bincount(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4") & 63, minlength=64)
        return np.minimum(counts, 255).astype("uint8") if kind[1] <= 255 else counts.astype("uint32")

    def _count(self, kind: tuple[bool, int], whole: str) -> None:
        import numpy as np

        table, n = self.counts[kind]
        row = self._letters(whole, kind)
        if n == len(table):
            table = np.concatenate([table, np.zeros((max(64, n), 64), dtype=row.dtype)])
        table[n] = row
        self.counts[kind] = [table, n + 1]

    def _by_counts(self, kind: tuple[bool, int], whole: str, least: int) -> list[int]:
        import numpy as np

        if kind not in self.counts:
            self.counts[kind] = [self._letters("", kind)[None, :].repeat(64, 0), 0]
            for r in self.lengths[kind]:
                self._count(kind, self._whole(r))
        table, n = self.counts[kind]
        common = np.minimum(table[:n], self._letters(whole, kind)).sum(1, dtype="int64")
        ranks = self.lengths[kind]
        return [ranks[i] for i in np.flatnonzero(common >= least)]


#: Values that the driver takes at a time to find leaders of token sets among.
TAKEN = 100_000


def token_set_leaders(values: DataFrame, threshold: float) -> dict[str, list[str]]:
    """Each column's leaders, in order, of a written table (column, value, n): by falling n, then value, each value that is alike to no leader before it.

    The driver takes the next TAKEN values in order; of the others those that are alike to one of these leaders leave, in a distributed pass.
    """
    size = {r["column"]: r["__n"] for r in values.groupBy("column").agg(F.count(F.lit(1)).alias("__n")).collect()}
    small = [c for c, n in size.items() if n <= LEADERS]
    out = _few_leaders(values.where(F.col("column").isin(*small)).collect() if small else [], threshold)
    for c in [c for c in size if c not in small]:
        rest, out[c] = values.where(F.col("column") == c).select("value", "n"), []
        while True:
            some = rest.orderBy(F.desc("n"), "value").limit(TAKEN).collect()
            found = _leaders([r["value"] for r in some], threshold)
            out[c] += found
            if len(some) < TAKEN:
                break
            last = some[-1]
            later = rest.where((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("value") > last["value"])))
            rest = tables.written(_unled(later, found, threshold), "values")
    return out


def _few(values: DataFrame) -> list | None:
    """All rows of a table of at most LEADERS; the driver is done with those before workers would have started. Of larger tables None."""
    some = values.limit(LEADERS + 1).collect()
    return some if len(some) <= LEADERS else None


def _few_leaders(values: Iterable, threshold: float) -> dict[str, list[str]]:
    """token_set_leaders of rows (column, value, n) on the driver."""
    own: dict[str, list] = {}
    for r in values:
        own.setdefault(r["column"], []).append((-r["n"], r["value"]))
    return {c: _leaders([v for _, v in sorted(found)], threshold) for c, found in own.items()}


def _leaders(values: Sequence[str], threshold: float) -> list[str]:
    known = TokenSetLeaders(threshold, values)
    for v in values:
        if known.first(v) is None:
            known.add(v)
    return known.values


def _known(leaders: Sequence[str], threshold: float) -> TokenSetLeaders:
    known = TokenSetLeaders(threshold, leaders)
    for v in leaders:
        known.add(v)
    return known


def _unled(values: DataFrame, leaders: Sequence[str], threshold: float) -> DataFrame:
    """The values (value, n) that are alike to none of the leaders."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        known = _known(leaders, threshold)
        for pdf in batches:
            yield pdf[pd.Series([known.first(v) is None for v in pdf["value"]], dtype="bool", index=pdf.index)]

    return values.mapInPandas(run, "value string, n bigint")


LED = "column string, form string, leader string, score double"


def _led_rows(values: Iterable[tuple[str, str]], leaders: dict[str, list[str]], threshold: float, known: dict | None = None) -> list[tuple]:
    """Rows of LED. known: what has been made of the leaders of each column so far."""
    known, out = {} if known is None else known, []
    for c, v in values:
        if c not in known:
            known[c] = _known(leaders[c], threshold)
        got = known[c].first(v)
        leader = v if got is None else known[c].values[got[0]]
        out.append((c, v, leader, 100.0 if leader == v else got[1]))
    return out


def _led(values: DataFrame, leaders: dict[str, list[str]], threshold: float) -> DataFrame:
    """column, form, leader, score of all values (column, value): the first of its column's leaders that each is alike to; leaders lead themselves."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        known: dict[str, TokenSetLeaders] = {}
        for pdf in batches:
            found = _led_rows(zip(pdf["column"], pdf["value"], strict=True), leaders, threshold, known)
            yield pd.DataFrame({"column": pdf["column"], "form": pdf["value"], "leader": [x[2] for x in found], "score": pd.Series([x[3] for x in found], dtype="float64")})

    return values.select("column", "value").mapInPandas(run, LED)


#: Values that the driver takes at a time to find leaders among.
LEADERS = 500


def alike_ratio(a: str, b: str, threshold: float) -> float | None:
    """sequence_ratio where it reaches the threshold; its upper bounds are looked at first."""
    m = difflib.SequenceMatcher(None, a, b)
    if 100.0 * m.real_quick_ratio() < threshold or 100.0 * m.quick_ratio() < threshold:
        return None
    score = 100.0 * m.ratio()
    return score if score >= threshold else None


def _scored(values: DataFrame, leaders: Sequence[str], alike: Callable[[str, str], float | None]) -> DataFrame:
    """value, n, leader, score of all values (value, n): the first leader that each is alike to, or null."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            found = [next(((a, s) for a in leaders if (s := alike(a, v)) is not None), (None, None)) for v in pdf["value"]]
            yield pd.DataFrame({"value": pdf["value"], "n": pdf["n"], "leader": [x[0] for x in found], "score": pd.Series([x[1] for x in found], dtype="float64")})

    return values.mapInPandas(run, "value string, n bigint, leader string, score double")


def counted(df: DataFrame, column: str) -> DataFrame:
    """value, n of the filled cells."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def greedy_all(values: DataFrame, alike: Callable[[str, str], float | None]) -> list[list[tuple[str, float | None]]]:
    """The clusters of greedy over all values (value, n) by falling n, then value; single ones are left out.

    The driver finds leaders among the next LEADERS values; then all others are scored against these and leave when alike, which is
    the same rule, as each value still joins the first leader in order.
    """
    rest = tables.written(values, "values")
    out = []
    while True:
        some = rest.orderBy(F.desc("n"), "value").limit(LEADERS).collect()
        if not some:
            return [c for c in out if len(c) > 1]
        clusters = {c[0][0]: c for c in greedy([r["value"] for r in some], alike)}
        out += clusters.values()
        if len(some) < LEADERS:
            return [c for c in out if len(c) > 1]
        last = some[-1]
        later = rest.where((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("value") > last["value"])))
        scored = tables.written(_scored(later, list(clusters), alike), "values")
        for r in scored.where("leader IS NOT NULL").orderBy(F.desc("n"), "value").collect():
            clusters[r["leader"]].append((r["value"], r["score"]))
        rest = scored.where("leader IS NULL").select("value", "n")


@any_header
def majority_mapping(df: DataFrame, columns: Sequence[str], threshold: float = 85) -> list[tuple]:
    """Values alike to their column's mode become it. All columns go through the same jobs."""
    if not columns:
        return []
    values = rows.cells(df, [], columns).select("column", T.strip(F.col("value")).alias("value")).where((F.col("value") != "") & ~F.lower("value").isin(*V.MISSING_VALUES))
    values = tables.written(values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "values")
    few = _few(values)
    if few is None:
        mode = {r["column"]: r["mode"] for r in values.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")).collect()}
    else:
        mode = {r["column"]: r["value"] for r in sorted(few, key=lambda r: (-r["n"], r["value"]), reverse=True)}

    def scored(c: str, v: str) -> float | None:
        # The score's sides are the other way round than among leaders.
        return alike_ratio(v, mode[c], threshold) if v != mode[c] else None

    if few is not None:
        return sorted((r["column"], r["value"], mode[r["column"]], "sequence", s) for r in few if (s := scored(r["column"], r["value"])) is not None)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            score = [scored(c, v) for c, v in zip(pdf["column"], pdf["value"], strict=True)]
            yield pdf[["column", "value"]].assign(score=pd.Series(score, dtype="float64", index=pdf.index))

    found = values.select("column", "value").mapInPandas(run, "column string, value string, score double").where("score IS NOT NULL AND NOT isnan(score)")
    return sorted((r["column"], r["value"], mode[r["column"]], "sequence", r["score"]) for r in found.collect())


@any_header
def name_mapping(df: DataFrame, column: str, threshold: float = 86) -> list[tuple]:
    """Names (normalised before) that are alike to a more frequent one."""
    clusters = greedy_all(counted(df, column), lambda a, b: alike_ratio(a.lower(), b.lower(), threshold))
    return [(column, v, c[0][0], "sequence", s) for c in clusters for v, s in c[1:]]


@any_header
def phone_mapping(df: DataFrame, column: str, threshold: float = 95) -> list[tuple]:
    """International numbers that are alike; the canonical one is the shortest of its cluster, then the smallest."""
    out = []
    for c in greedy_all(counted(df.where(F.col(column).startswith("+")), column), lambda a, b: s if (s := ratio(a, b)) >= threshold else None):
        best = min((v for v, _ in c), key=lambda v: (len(v), v))
        out += [(column, v, best, "ratio", s or 100.0) for v, s in c if v != best]
    return out


@any_header
def exact_clusters(df: DataFrame, column: str, normalise: Callable = T.arabic_plain) -> DataFrame:
    """raw, normal, n, master: values of one normal form get the most frequent of them (ties: the smallest). Fully distributed."""
    raw = df.select(T.strip(F.col(column)).alias("raw")).where("raw IS NOT NULL").groupBy("raw").agg(F.count(F.lit(1)).alias("n")).withColumn("normal", normalise(F.col("raw")))
    best = raw.groupBy("normal").agg(F.max("n").alias("__top"))
    master = raw.join(best, "normal").where(F.col("n") == F.col("__top")).groupBy("normal").agg(F.min("raw").alias("master"))
    return raw.join(master, "normal").select("raw", "normal", "n", "master")


@any_header
def short_pairs(df: DataFrame, column: str, normalise: Callable = T.arabic_plain, shorter_than: int = 4) -> DataFrame:
    """a, b, distance: pairs of normal forms a < b of which one is short, at an edit distance of 1 or less."""
    forms = exact_clusters(df, column, normalise).select("normal").distinct().where(F.length("normal") <= shorter_than)
    short = forms.where(F.length("normal") < shorter_than).select(F.col("normal").alias("__short"))
    pairs = forms.join(short, (F.col("normal") != F.col("__short")) & (F.abs(F.length("normal") - F.length("__short")) <= 1))
    pairs = pairs.select(F.least("normal", "__short").alias("a"), F.greatest("normal", "__short").alias("b")).distinct()
    return pairs.select("a", "b", F.levenshtein("a", "b").alias("distance")).where("distance <= 1")


@any_header
def semantic_mapping(df: DataFrame, column: str, config: V.ClusteringConfig = V.PRESETS["BALANCED"], normalise: Callable = T.arabic_plain) -> list[tuple]:
    """Leaders by the frequency of normal forms: forms of fewer than four characters match at an edit distance of 1, others by the weighted ratio; columns outside the bounds are left alone."""
    forms = exact_clusters(df, column, normalise)
    rows_of = forms.orderBy("normal", F.desc("n"), "raw")
    size = forms.agg(F.count_distinct("normal")).first()[0]
    if not config.min_unique_values <= size <= config.max_unique_values:
        return []
    got = rows_of.collect()  # spellings of at most max_unique_values forms
    total, raws = Counter(), {}
    for r in got:
        total[r["normal"]] += r["n"]
        raws.setdefault(r["normal"], []).append((r["raw"], r["master"]))

    def alike(a: str, b: str) -> float | None:
        if min(len(a), len(b)) < 4:
            d = edit_distance(a, b)
            return float(d) if d <= 1 else None
        s = weighted_ratio(a, b)
        return s if s >= config.fuzzy_threshold else None

    out = []
    for cluster in greedy(sorted(total, key=lambda f: (-total[f], f)), alike):
        leader = cluster[0][0]
        master = raws[leader][0][1]
        for form, score in cluster:
            method = "normalized_exact" if form == leader else "levenshtein" if min(len(form), len(leader)) < 4 else "weighted_ratio"
            out += [(column, raw, master, method, score) for raw, _ in raws[form] if raw != master]
    return out


@any_header
def weighted_mapping(df: DataFrame, column: str, threshold: float = 80, max_unique: int = 500, min_unique: int = 2, normalise: Callable = T.arabic_plain) -> list[tuple]:
    """The plain form of semantic clustering: by the weighted ratio of normal forms alone; spellings of a cluster get the most frequent spelling of its leader's form. Columns outside the bounds are left alone."""
    spelt = tables.written(spellings(df, [column], normalise), "spellings")
    forms = spelt.groupBy(F.col("form").alias("value")).agg(F.sum("n").alias("n"))
    if not min_unique <= forms.count() <= max_unique:
        return []
    clusters = greedy([r["value"] for r in forms.orderBy(F.desc("n"), "value").collect()], lambda a, b: s if (s := weighted_ratio(a, b)) >= threshold else None)
    raws: dict[str, list[str]] = {}
    for r in spelt.orderBy(F.desc("n"), "value").collect():
        raws.setdefault(r["form"], []).append(r["value"])
    return [(column, v, raws[c[0][0]][0], "weighted_ratio", s or 100.0) for c in clusters for f, s in c for v in raws[f] if v != raws[c[0][0]][0]]


@any_header
def weighted_harmonise(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 80, max_unique: int = 500, min_unique: int = 2, normalise: Callable = T.arabic_plain) -> tuple[DataFrame, DataFrame]:
    found = [m for c in (columns or rows.text_columns(df)) for m in weighted_mapping(df, c, threshold, max_unique, min_unique, normalise)]
    return apply_mapping(df, found), mapping_frame(df, found)


def mapping_frame(df: DataFrame, mapping: Sequence[tuple]) -> DataFrame:
    return tables.local(df.sparkSession, mapping, MAPPING)


def apply_mapping(df: DataFrame, mapping: Sequence[tuple] | DataFrame) -> DataFrame:
    """Replaces the mapped values; outer blanks of a cell and of a mapped value don't count. Rows are neither lost nor repeated. mapping: rows of MAPPING, or a written table of them."""
    table = isinstance(mapping, DataFrame)
    mapped = {r["column"] for r in mapping.select("column").distinct().collect()} if table else {m[0] for m in mapping}
    for c in [c for c in df.columns if c in mapped]:
        small = mapping.where(F.col("column") == c) if table else mapping_frame(df, [m for m in mapping if m[0] == c])
        small = small.groupBy(T.strip(F.col("old_value")).alias("__old")).agg(F.min("new_value").alias("__new"))
        df = df.join(small, T.strip(F.col(quoted(c))) == F.col("__old"), "left").select(*(F.coalesce("__new", quoted(x)).alias(x) if x == c else F.col(quoted(x)) for x in df.columns))
    return df


@any_header
def harmonise(df: DataFrame, columns: Sequence[str] | None = None, config: V.ClusteringConfig = V.PRESETS["BALANCED"], normalise: Callable = T.arabic_plain) -> tuple[DataFrame, DataFrame]:
    """The table with each column's spellings unified, and the mapping with scores."""
    found = [m for c in (columns or rows.text_columns(df)) for m in semantic_mapping(df, c, config, normalise)]
    return apply_mapping(df, found), mapping_frame(df, found)


@any_header
def token_set_harmonise(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 90, max_unique: int | None = None, normalise: Callable | None = T.squeeze) -> tuple[DataFrame, DataFrame]:
    columns = list(columns) if columns is not None else [c for c in rows.text_columns(df) if not detect.header_has(c, V.PHONE_HEADERS)]
    found = token_set_found(df, columns, threshold, max_unique, normalise)
    return apply_mapping(df, found), found


@any_header
def clean_names(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 86) -> tuple[DataFrame, DataFrame]:
    columns = list(columns) if columns is not None else [c for c in detect.name_columns(df) if c in rows.text_columns(df)]
    df = df.select(*(T.person_name(F.col(c)).alias(c) if c in columns else c for c in df.columns))
    found = [m for c in columns for m in name_mapping(df, c, threshold)]
    return apply_mapping(df, found), mapping_frame(df, found)


@any_header
def majority_words(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 85) -> tuple[DataFrame, DataFrame]:
    found = majority_mapping(df, list(columns if columns is not None else rows.text_columns(df)), threshold)
    return apply_mapping(df, found), mapping_frame(df, found)


def correction_summary(mapping: DataFrame) -> DataFrame:
    """column, corrections, masters."""
    return mapping.groupBy("column").agg(F.count(F.lit(1)).alias("corrections"), F.count_distinct("new_value").alias("masters"))


def shown(mapping: DataFrame, most: int = 200) -> DataFrame:
    """The first corrections as lines of text."""
    return mapping.orderBy("column", "new_value", "old_value").limit(most).select("column", F.format_string("%s -> %s (%s)", "old_value", "new_value", "method").alias("line"))


@any_header
def before_after(df: DataFrame, mapping: DataFrame, column: str, most: int = 6) -> DataFrame:
    """old_value, new_value, n of rows, the most frequent first."""
    mine = mapping.where(F.col("column") == column).select("old_value", "new_value")
    return df.join(mine, T.strip(F.col(column)) == F.col("old_value")).groupBy("old_value", "new_value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "old_value").limit(most)
