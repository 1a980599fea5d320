"""Merkle manifest, collocations and fingerprints against brute-force versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from landfold.llm import collocations, merkle, sketches

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def t(text):
    return text or ""


# --- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(i, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n_chars, text)))


def brute_tree(leaves):
    """The levels of a tree."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def brute_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in order:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(*r)))
        built[lang] = brute_tree([brute_leaf(*r) for r in trees[lang]])
    forest = brute_tree([built[lang][-1][0] for lang in order])
    root, out = forest[-1][0], Counter()
    for place, lang in enumerate(order):
        for k, r in enumerate(trees[lang]):
            siblings, fold = [], brute_leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                fold = brute_leaf(*r[:4], r[4] + 1)
            for levels, at in ((built[lang], k), (forest, place)):
                for level in levels[:-1]:
                    beside = level[at ^ 1] if at ^ 1 < len(level) else ""
                    siblings.append(beside)
                    fold = sha(beside, fold) if at & 1 else sha(fold, beside)
                    at >>= 1
            out[r[0], brute_leaf(*r), built[lang][-1][0], sha(*siblings), fold, fold == root] += 1
    return root, out


@pytest.mark.parametrize("block", [2, 9])
def test_manifest(clashing, rows, block, monkeypatch):
    for name in ("append_logs", "read_paths"):
        monkeypatch.setattr(getattr(merkle, name), "__defaults__", (block,))
    typed = clashing.withColumn("position", F.lit("x"))
    found = merkle.build(typed, merkle.tampered_leaf())
    root, want = brute_manifest(rows)
    assert found.root == root
    got = Counter((r.doc_id, r.leaf, r.subroot, r.proof_sha256, r.folded_root, r.folded_root == root) for r in found.proofs().collect())
    assert got == want
    assert {v for *_, v in want} == {True, False}
    for tree in {r.tree for r in found.log().select("tree").distinct().collect()}:
        log = found.log().where(F.col("tree") == F.lit(bytes(tree))).orderBy("position").collect()
        assert [r.position for r in log] == list(range(len(log)))
        assert log[-1].number == 0 and log[-1].level == max(r.level for r in log)


def test_positions_are_postorder():
    def walk(level, number, n, out):
        if level:
            for child in (2 * number, 2 * number + 1):
                if child << level - 1 < n:
                    walk(level - 1, child, n, out)
        out.append((level, number))
        return out

    for n in range(1, 140):
        nodes = walk(merkle.height(n), 0, n, [])
        assert [merkle.position(level, number, n) for level, number in nodes] == list(range(len(nodes)))


def test_manifest_of_few_and_none(spark, empty):
    lone = spark.createDataFrame([(7, "one", None, "s", 3)], SCHEMA)
    found = merkle.build(lone)
    assert found.root == brute_leaf(7, "one", None, "s", 3)
    assert [(r.proof_sha256, r.folded_root) for r in found.proofs().collect()] == [(sha(), found.root)]
    assert merkle.build(empty).root is None


# --- collocations


def brute_counts(rows):
    counts, words_of = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t(text))
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            words_of[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    return counts, words_of


def brute_collocations(rows, least, covered, top):
    counts, words_of = brute_counts(rows)
    out = []
    for lang, found in counts.items():
        good = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in good.items():
            longer = (b for q, b in good.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(100 * b >= covered * a for b in longer):
                continue
            score, k = min((2000000 * a // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        out += [(lang, n, p.decode(), -a, left, right, words_of[lang], -score) for n, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


ODD = [
    (500, "New York, New York. new york;new\tyork", "en", "s", 1), (501, "a a a a a a a", None, "s", 1), (502, "a a a", "und", "s", 1),
    (503, "É é É é. x\x0by\x0cz\rq", "en", "s", 1), (504, "tab\tand nbsp in  line", "en", "s", 1), (505, "z" * 70_000 + " " + "z" * 70_000, "en", "s", 1),
]


@pytest.mark.parametrize(("route_bytes", "most_routes", "least"), [(16 << 20, 50_000, 5), (2_000, 50_000, 2), (4_000, 12, 30)])
def test_collocations(clashing, rows, spark, route_bytes, most_routes, least):
    """Few and many routes to a shuffle, and several shuffles: borders cut phrases, whose parts add up."""
    docs = clashing.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(ODD, SCHEMA)).withColumns({"phrase": F.lit("x"), "route": F.lit("x")})
    counts = collocations.phrase_counts(docs, least, route_bytes, most_routes)
    want, words = brute_counts(rows + ODD)
    got = {(r.lang, r.phrase): r.f for r in counts.where("k > 0").collect()}
    assert got == {(lang, " ".join(p)): f for lang, found in want.items() for p, f in found.items() if f >= least}
    assert {r.lang: r.f for r in counts.where("k = 0").collect()} == dict(words)
    ranked = sorted(tuple(r) for r in collocations.collocations(counts, top=40).collect())
    assert ranked == brute_collocations(rows + ODD, least, 80, 40)


def test_collocations_of_nothing(empty):
    assert collocations.collocations(collocations.phrase_counts(empty)).count() == 0


def test_three_way_sort():
    rng = np.random.default_rng(3)
    for least in (1, 4, 30):
        words = np.minimum(rng.zipf(1.4, (3000, 4)), 50).astype(np.int32)
        for row in words[::5]:
            row[rng.integers(1, 5) :] = -1
        weights = rng.integers(1, 4, len(words))
        want = Counter()
        for row, w in zip(words.tolist(), weights.tolist(), strict=True):
            for k in range(1, 5):
                if row[k - 1] >= 0:
                    want[tuple(row[:k])] += w
        at, depth, weight = collocations.three_way(words, weights, np.zeros(words.shape, bool), least)
        got = {tuple(words[a, :d].tolist()): w for a, d, w in zip(at, depth.tolist(), weight.tolist(), strict=True)}
        assert len(at) == len(got) and got == {p: w for p, w in want.items() if w >= least}


def test_scores_beyond_64_bits(spark):
    """Counts near 10^18: products pass 64 bits."""
    big = 9 * 10**17
    counts = [("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 3), ("en", None, 0, 4 * big)]
    row = collocations.collocations(spark.createDataFrame(counts, "lang string, phrase string, k int, f bigint")).first()
    assert row.score == 2000000 * big // (2 * big + 4) and row.n == 4 * big


# --- fingerprints


def brute_likeness(a, b):
    a, b = (Counter(sketches.paragraphs(x.encode())) for x in (a, b))
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_neighbours(clashing, rows):
    """Documents follow by doc_id; rows that share one by their text's hash."""
    hashes = {r.text: r.h for r in clashing.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((r[0], t(r[1])) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = Counter()
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        want[i, len(text), hashlib.sha256(new.encode()).hexdigest(), round(brute_likeness(text, new), 9), round(brute_likeness(text, after), 9)] += 1
    found = sketches.with_neighbours(clashing.withColumns({"hash": F.lit("x"), "part": F.lit("x"), "head": F.lit("x"), "row_no": F.lit("x")})).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == want
    prints = {}
    texts = {i: x for i, x in order if i not in (408, 409, None)}
    for r in found:
        if r.doc_id in texts:
            assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) > len(prints) * 0.98  # texts of blanks have no paragraph
    assert {r.cells_next for r in found} > {sketches.CELLS}  # larger sketches were needed


def test_neighbours_of_one_and_none(spark, empty):
    (row,) = sketches.with_neighbours(spark.createDataFrame([(1, "ab\ncd")], "doc_id bigint, text string")).collect()
    assert (row.n_chars, row.near_next, row.edited_sha256) == (5, 1.0, hashlib.sha256(b"ab\nab").hexdigest())
    assert sketches.with_neighbours(empty).count() == 0


def test_peeling_recovers_what_differs():
    rng = random.Random(5)
    say = lambda n: "\n".join(f"line {rng.randrange(400)}" for _ in range(n))
    lefts, rights = [say(rng.randrange(0, 300)) for _ in range(60)], []
    for x in lefts:
        lines = x.split("\n")
        for _ in range(rng.choice([0, 1, 5, 80])):
            lines[rng.randrange(len(lines))] = f"new {rng.randrange(99)}"
        rights.append("\n".join(lines))
    flat, starts = sketches.digests([x.encode() for x in lefts + rights])
    n, took, (pair, digest, sign) = sketches.differing(flat, starts, np.arange(60), np.arange(60) + 60)
    assert len(set(took.tolist())) > 2
    for k in range(60):
        a, b = (set(flat[starts[x] : starts[x + 1]].tolist()) for x in (k, k + 60))
        assert n[k] == len(a ^ b)
        for one, want in ((1, a - b), (-1, b - a)):
            assert set(digest[(pair == k) & (sign == one)].tolist()) == want


def test_paragraphs():
    lines = sketches.paragraphs(b"short line\n\n \n" + b"word " * 100 + b"\nlast. " + b"x" * 5000 + b" tail")
    assert lines[0] == b"short line" and b"".join(lines[1:]).replace(b" ", b"") == (b"word" * 100 + b"last." + b"x" * 5000 + b"tail")
    text = "Ein Satz über etwas. " * 40
    assert "".join(p.decode() for p in sketches.paragraphs(text.encode())).strip() == text.strip()


def test_large_sketches():
    """A text of 100,000 paragraphs against one of its halves."""
    whole = "\n".join(f"p{k}" for k in range(100_000))
    half = "\n".join(f"p{k}" for k in range(50_000))
    flat, starts = sketches.digests([whole.encode(), half.encode()])
    n, took, _ = sketches.differing(flat, starts, np.array([0]), np.array([1]))
    assert n.tolist() == [50_000] and took[0] > 50_000
