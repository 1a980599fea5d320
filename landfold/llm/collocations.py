"""Phrase collocations: multikey three-way quicksort of suffix pointers, to the depth of the longest phrase.

Every word begins a suffix, of which the first LONGEST words within its piece matter. Suffixes are combined in each mapper
and routed by their leading words: by ranges of the words' hashes, whose borders come from a bounded sample of suffixes, so
that a very common word, pair or triple is cut into as many routes as it needs. In a route pointers to its suffixes are
sorted by three-way quicksort, all open partitions at once: a partition's pivot word splits it into less, equal and greater;
the weight of an equal partition is the count of its phrase, and it goes on with the next word. Partitions of less weight
than the least count are abandoned, whole. Only a phrase that a route's border cuts is counted in part in each of its routes,
and its parts are added up; so the sample decides about evenness alone. A corpus with more routes than one shuffle should
have is read several times, each time for a range of routes.

Defined results: a null text is empty, a null language is `und`, together with the language of that name; texts and pieces
are read whole, whatever their length; repeated rows count as often as they come; a phrase occurs in overlaps as well; a
language without candidates has no rows; other columns, of whatever name, and doc_id play no part; an empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.llm.common import staged, table, text_of

LONGEST, LEAST, TOP = 4, 30, 2000
#: A longer candidate with this share of a candidate's count, in per cent, drops it.
COVERED = 80
#: Bytes of text to a route, routes to a shuffle, sampled suffixes to a route.
ROUTE_BYTES, MOST_ROUTES, SAMPLES = 8 << 20, 50_000, 200
#: Of a sampled document's suffixes one in THIN is taken; words that a mapper combines at a time.
THIN, COMBINED = 16, 800_000
SALTS = 64

#: A-Z to a-z, ends of pieces to a full stop, the tabulator to a blank.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9 + b" ")


class Suffixes:
    """Words of one language as numbers; 0 is the end of a piece."""

    def __init__(self, lang: str):
        self.lang, self.numbers, self.known = lang, array("i"), defaultdict()
        self.known.default_factory = self.known.__len__
        self.end = self.known[b"."]

    def add(self, text: bytes) -> None:
        self.numbers.extend(map(self.known.__getitem__, text.translate(_BYTES).replace(b".", b" . ").split()))
        self.numbers.append(self.end)

    def columns(self) -> list[np.ndarray]:
        """The first LONGEST words of each suffix; -1 beyond a piece's end."""
        first = np.frombuffer(self.numbers, np.int32)
        out, keep = [first], np.flatnonzero(first != self.end)
        for k in range(1, LONGEST):
            later = np.concatenate([first[k:], np.full(min(k, len(first)), self.end, np.int32)])
            out.append(np.where(out[-1] == self.end, self.end, later))
        return [np.where(c == self.end, -1, c)[keep] for c in out]

    def hashes(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return hash_keys(word_hashes(self.known), self.lang, columns)


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    """Of 32 bits, and 0 for no word."""
    return np.array([*map(zlib.crc32, words), 0], np.uint64)


def hash_keys(hashes: np.ndarray, lang: str, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two unsigned numbers of 64 bits that sort suffixes by their words' hashes, the first word's with its language; 0 where
    a word is missing."""
    first = hashes ^ np.uint64(zlib.crc32(lang.encode()))
    up = np.uint64(32)
    return first[columns[0]] << up | hashes[columns[1]], hashes[columns[2]] << up | hashes[columns[3]]


def route_of(high: np.ndarray, low: np.ndarray, borders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many borders are at or below each key."""
    left, right = (np.searchsorted(borders[0], high, side) for side in ("left", "right"))
    route, tied = left.copy(), np.flatnonzero(left < right)
    for at in np.unique(left[tied]):  # a border's first two words
        own = tied[left[tied] == at]
        route[own] += np.searchsorted(borders[1][at : right[own[0]]], low[own], "right")
    return route


def combined(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct suffixes, sorted, with their counts."""
    size += 1
    heads, head = np.unique((columns[0] + np.int64(1)) * size + columns[1] + 1, return_inverse=True)
    tails, tail = np.unique((columns[2] + np.int64(1)) * size + columns[3] + 1, return_inverse=True)
    both, counts = np.unique(head * len(tails) + tail, return_counts=True)
    pairs = (heads[both // len(tails)], tails[both % len(tails)]) if len(both) else (heads, tails)
    return [part - 1 for pair in pairs for part in (pair // size, pair % size)], counts


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[Suffixes]:
    held, n = {}, 0
    for rows in batches:
        for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").cast(pa.binary()), strict=True):
            own = held.get(lang) or held.setdefault(lang, Suffixes(lang))
            before = len(own.numbers)
            own.add(text.as_py())
            n += len(own.numbers) - before
            if n >= COMBINED:
                yield from held.values()
                held, n = {}, 0
    yield from held.values()


Range = tuple[tuple[int, int] | None, tuple[int, int] | None]


def _within(high: np.ndarray, low: np.ndarray, inside: Range) -> np.ndarray:
    keep = np.ones(len(high), bool)
    for end, upper in zip(inside, (False, True), strict=True):
        if end is not None:
            at, beside = np.uint64(end[0]), np.uint64(end[1])
            keep &= (high < at) | (high == at) & (low < beside) if upper else (high > at) | (high == at) & (low >= beside)
    return keep


def sampled_borders(docs: DataFrame, n_bytes: int, routes: int, parts: int, inside: Range) -> tuple[np.ndarray, np.ndarray]:
    """Keys that cut the suffixes of a range of keys into about equal parts, from SAMPLES suffixes a part. routes: how many
    such parts all suffixes make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _suffixes(batches):
            high, low = own.hashes([c[::THIN] for c in own.columns()])
            keep = _within(high, low, inside)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep].astype(np.int64)) for x in (high, low)], ["high", "low"])

    share = min(1.0, SAMPLES * THIN * routes / max(1, n_bytes / 6))
    found = docs.sample(share, seed=42).mapInArrow(run, "high bigint, low bigint").toArrow()  # SAMPLES * parts rows, about
    high, low = (found.column(c).to_numpy().astype(np.uint64) for c in ("high", "low"))
    order = np.lexsort((low, high))
    cuts = order[np.arange(1, parts) * len(order) // parts] if len(order) else order
    cuts = np.unique(np.stack([high[cuts], low[cuts]], 1), axis=0)
    return cuts[:, 0], cuts[:, 1]


def routed(docs: DataFrame, borders: tuple[np.ndarray, np.ndarray], inside: Range) -> DataFrame:
    """A row for each route that a mapper has suffixes for: suffixes line by line, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _suffixes(batches):
            columns, counts = combined(own.columns(), len(own.known))
            high, low = own.hashes(columns)
            keep = np.flatnonzero(_within(high, low, inside))
            if not len(keep):
                continue
            route = route_of(high[keep], low[keep], borders)
            order = np.argsort(route, kind="stable")
            route, keep = route[order], keep[order]
            starts = np.flatnonzero(np.diff(route, prepend=-1))
            words = pa.array(own.known, pa.large_binary())
            said = [words.take(pa.array(c[keep], mask=c[keep] < 0)) for c in columns]
            lines = pc.binary_join_element_wise(*said, pa.scalar(b" ", pa.large_binary()), null_handling="skip")
            ends = np.append(starts, len(keep))
            blobs = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), lines), pa.scalar(b"\n", pa.large_binary()))
            sizes = [counts[keep[a:b]].astype("<i4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            for k in range(0, len(starts), 64):
                some = slice(k, k + 64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route[starts[some]], pa.int32()), pa.array([own.lang] * len(starts[some])), blobs[some].cast(pa.binary()), pa.array(sizes[some], pa.binary())],
                    ["route", "lang", "suffixes", "counts"])

    return docs.mapInArrow(run, "route int, lang string, suffixes binary, counts binary")


def three_way(words: np.ndarray, weights: np.ndarray, cut: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts pointers to suffixes (rows of words, -1 beyond their end) and counts prefixes. cut: whether a border may cut the
    prefix of each depth, which is then never abandoned. Returns of each prefix found a suffix, its depth and its weight."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = np.arange(len(words))
    starts, depths = np.zeros(min(1, len(at)), np.int64), np.zeros(min(1, len(at)), np.int64)
    while len(starts):
        sizes = np.diff(np.append(starts, len(at)))
        part = np.repeat(np.arange(len(starts)), sizes)
        depth = depths[part]
        value = words[at, depth]
        pivot = words[at[starts + sizes // 2], depths]
        side = np.where(value < pivot[part], 0, np.where(value == pivot[part], 1, 2))
        key = part * 3 + side
        counts = np.bincount(key, minlength=3 * len(starts))
        # Each pointer's new place: the first one of its side, and how many of that side stand before it.
        place = np.empty(len(at), np.int64)
        firsts = np.cumsum(counts) - counts
        for s in range(3):
            mine = side == s
            before = np.cumsum(mine) - mine
            place[mine] = (before - before[starts][part] + firsts[part * 3 + s])[mine]
        moved = np.empty_like(at)
        moved[place] = at
        at = moved
        some = np.flatnonzero(counts)
        firsts, counts, sides, depth_of = firsts[some], counts[some], some % 3, depths[some // 3]
        weight = np.add.reduceat(weights[at], firsts)
        kept = weight >= least
        if cut.any():
            kept |= np.logical_or.reduceat(cut[at, np.repeat(depth_of, counts)], firsts)
        equal = kept & (sides == 1)
        found.append((at[firsts[equal]], depth_of[equal] + 1, weight[equal]))
        deeper = np.where(sides == 1, depth_of + 1, depth_of)
        kept &= deeper < words.shape[1]
        stay = np.repeat(kept, counts)
        new = np.repeat(np.arange(len(some)), counts)[stay]
        at, deep = at[stay], deeper[new]
        goes_on = words[at, deep] >= 0  # suffixes that end here have been counted
        at, new = at[goes_on], new[goes_on]
        starts = np.flatnonzero(np.diff(new, prepend=-1))
        depths = deeper[new[starts]]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Route:
    """The suffixes of a route, by language."""

    def __init__(self) -> None:
        self.words, self.sizes, self.counts = defaultdict(list), defaultdict(list), defaultdict(list)

    def add(self, lang: str, suffixes: pa.Array, counts: bytes) -> None:
        split = pc.split_pattern(pc.split_pattern(suffixes, b"\n").flatten(), b" ")
        self.words[lang].append(split.flatten().dictionary_encode())
        self.sizes[lang].append(np.diff(split.offsets.to_numpy()).astype(np.int8))
        self.counts[lang].append(np.frombuffer(counts, "<i4"))

    def rows(self, lang: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words, the suffixes as rows of their numbers, and their weights."""
        coded = pa.chunked_array(self.words.pop(lang)).unify_dictionaries()
        number = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
        sizes = np.concatenate(self.sizes.pop(lang))
        rows = np.full((len(sizes), LONGEST), -1, np.int32)
        rows[np.arange(LONGEST) < sizes[:, None]] = number
        return coded.chunk(0).dictionary, rows, np.concatenate(self.counts.pop(lang)).astype(np.int64)

    def phrases(self, borders: tuple[np.ndarray, np.ndarray], route: int, inside: Range, least: int) -> Iterator[pa.RecordBatch]:
        """Counts of phrases, and with k = 0 and no phrase those of all words."""
        ends = [(int(borders[0][k]), int(borders[1][k])) for k in (route - 1, route) if 0 <= k < len(borders[0])]
        ends += [e for e in inside if e is not None]
        for lang in list(self.words):
            names, rows, weights = self.rows(lang)
            cut = cut_prefixes(hash_keys(word_hashes(names.to_pylist()), lang, list(rows.T)), ends)
            at, depth, weight = three_way(rows, weights, cut, least)
            said = []
            for k in range(LONGEST):
                number = np.where(depth > k, rows[at, k], -1)
                said.append(names.take(pa.array(number, mask=number < 0)))
            phrase = pc.binary_join_element_wise(*said, pa.scalar(b" ", names.type), null_handling="skip").cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), phrase, pa.array(depth, pa.int32()), pa.array(weight, pa.int64())], ["lang", "phrase", "k", "f"])
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([int(weights.sum())], pa.int64())], ["lang", "phrase", "k", "f"])


def cut_prefixes(keys: tuple[np.ndarray, np.ndarray], ends: list[tuple[int, int]]) -> np.ndarray:
    """Of each suffix and depth whether one of these borders has a prefix with the same hashes, and so may cut it."""
    cut = np.zeros((len(keys[0]), LONGEST), bool)
    for end in ends:
        same = np.ones(len(keys[0]), bool)
        for depth in range(LONGEST):
            shift = 32 * (1 - depth % 2)
            same &= keys[depth // 2] >> np.uint64(shift) == np.uint64(end[depth // 2] >> shift)
            cut[:, depth] |= same
    return cut


def counted(suffixes: DataFrame, borders: tuple[np.ndarray, np.ndarray], inside: Range, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, route = Route(), None
        for rows in batches:
            for k in range(rows.num_rows):
                route = rows.column("route")[k].as_py()
                own.add(rows.column("lang")[k].as_py(), rows.column("suffixes").slice(k, 1), rows.column("counts")[k].as_py())
        if route is not None:
            yield from own.phrases(borders, route, inside, least)

    routes = len(borders[0]) + 1
    return suffixes.repartitionById(routes, F.col("route")).mapInArrow(run, "lang string, phrase string, k int, f bigint")


def phrase_counts(docs: DataFrame, least: int = LEAST, route_bytes: int = ROUTE_BYTES, most_routes: int = MOST_ROUTES) -> DataFrame:
    """lang, phrase, k words, f, of all phrases of up to LONGEST words with f >= least; k = 0 has all words of a language."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routes = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // route_bytes + 1)
    passes = -(-routes // most_routes)
    edges = sampled_borders(rows, n_bytes, passes, passes, (None, None)) if passes > 1 else None
    edges = list(zip(*(x.tolist() for x in edges), strict=True)) if edges else []
    parts = None
    for inside in zip([None, *edges], [*edges, None], strict=True):
        borders = sampled_borders(rows, n_bytes, routes, -(-routes // passes), inside)
        own = counted(routed(rows, borders, inside), borders, inside, least)
        parts = staged(own, "collocation-parts") if parts is None else parts.unionByName(staged(own, "collocation-parts"))
    sums = parts.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))
    return staged(sums.where((F.col("f") >= least) | (F.col("k") == 0)), "collocation-counts")


def collocations(counts: DataFrame, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """Scores candidates by their worst cut, drops those that a longer one covers, ranks the rest by language. All parts of a
    candidate are as frequent as it is, so that the joins find them."""
    part = counts.where("k > 0").select("lang", "phrase", "f")
    candidates = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    said = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = cuts.select("lang", "phrase", "a", "cut", said(F.lit(1), F.col("cut")).alias("head"), said(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast(cast(2000000 as decimal(18, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0))) as bigint)")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"), F.first("a").alias("a"))
    inner = candidates.where("k > 2").withColumn("start", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    inner = inner.withColumn("size", F.explode(F.expr("sequence(2, least(k - 1, k - start + 1))")))
    longer = inner.select("lang", said(F.col("start"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    scored = worst.join(longer, ["lang", "phrase"], "left").where(f"cover IS NULL OR 100 * cover < {covered} * a")
    scored = scored.select("lang", "phrase", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), F.col("w.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = scored.withColumn("_salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    first = first.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).where(f"rank <= {top}")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(f"rank <= {top}")
    words = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(phrase_counts(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable] = {"op12_collocations": op12_collocations}
_GRAMS = " UNION ALL ".join(
    f"SELECT lang, array_to_string(w[i:i + {k - 1}], ' ') AS phrase, {k} AS k FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM words WHERE len(w) >= {k})" for k in range(1, LONGEST + 1)
)
ORACLE_SQL = {
    "op12_collocations": rf"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
        counts AS (SELECT lang, phrase, k, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {LEAST}),
        candidates AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
        cuts AS (
            SELECT c.lang, c.phrase, c.a, c.cut, h.f AS l, t.f AS r, ((2000000::HUGEINT * c.a) // (h.f + t.f))::BIGINT AS score
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
            JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.cut], ' ')
            JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')),
        worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        covers AS (
            SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS cover
            FROM (SELECT *, unnest(range(2, k)) AS m FROM (SELECT *, unnest(range(1, k)) AS i FROM candidates)) WHERE i + m - 1 <= k GROUP BY ALL),
        kept AS (SELECT w.* FROM worst w LEFT JOIN covers v USING (lang, phrase) WHERE v.cover IS NULL OR 100 * v.cover < {COVERED} * w.a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept QUALIFY rank <= {TOP})
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang)""",
}
