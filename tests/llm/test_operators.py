"""The text operators against brute-force versions on small tables."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from landfold.llm import bpe, chat, exact_dedup, mixing, pii, quality_model, quality_rules, sharding, simhash, token_files
from landfold.llm.common import scratch


def t(text):
    return text or ""


# --- exact dedup


def test_exact_dedup_verdicts(docs, rows, spark):
    got = exact_dedup.verdicts(docs, exact_dedup.new_index(spark), "b").collect()
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[t(text)].append(i)
    want = Counter()
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        for i in ids:
            want[i, top, len(ids), sha] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_goes_through_the_index(spark):
    """The second part's texts that the first has put into the index are removed by the anti-join."""
    rows = [(k, f"text {k % 7}") for k in range(100)] + [(k, f"low {k}") for k in range(3)]
    index = exact_dedup.new_index(spark)
    _, sizes, news = exact_dedup.dedup_feed(spark.createDataFrame(rows, "doc_id bigint, text string"), index, "f")
    assert news == [7, 3]  # all seven texts of the upper half again in the lower one
    assert Counter(r.group_size for r in sizes.collect()) == Counter({1: 3, 14: 5, 15: 2})
    assert index.read().count() == 17 and index.read().where("keep_id >= 93").agg(F.sum("n")).first()[0] == 100
    index.drop()
    assert not index.generations()


def test_exact_dedup_second_feed_repeated_and_compacted(spark):
    index = exact_dedup.new_index(spark)
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id bigint, text string")
    second = spark.createDataFrame([(9, "a"), (8, "c"), (7, "c")], "doc_id bigint, text string")
    exact_dedup.verdicts(first, index, "one").collect()
    for k in range(3):  # the same feed again gives the same
        got = {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in exact_dedup.verdicts(second, index, "two").collect()}
        assert got == {9: (2, False, 3), 8: (8, True, 2), 7: (8, False, 2)}
        if k == 1:
            index.compact()
            assert sorted((r.keep_id, r.n, r.feed) for r in index.read().select("keep_id", "n", "feed").collect()) == [(2, 1, "two"), (2, 2, "one"), (3, 1, "one"), (8, 2, "two")]
    index.drop()


def test_only_the_latest_ended_run_of_a_feed_counts(spark, monkeypatch):
    index = exact_dedup.new_index(spark)
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id bigint, text string")
    told = lambda docs, feed: {r.doc_id: (r.kept, r.group_size) for r in exact_dedup.verdicts(docs, index, feed).collect()}
    told(frame((1, "x"), (2, "x"), (3, "gone")), "A")
    assert told(frame((1, "x"), (2, "x")), "A") == {1: (False, 2), 2: (True, 2)}
    assert told(frame((7, "x"), (8, "gone")), "B") == {7: (False, 3), 8: (True, 1)}
    # A later run of A fails after its first part: the earlier one goes on counting, before and after compact().
    appended = index.append
    monkeypatch.setattr(index, "append", lambda rows: (appended(rows), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        told(frame((1, "x"), (5, "new")), "A")
    monkeypatch.setattr(index, "append", appended)
    for k in range(2):
        assert told(frame((7, "x"), (8, "gone"), (9, "new")), "B") == {7: (False, 3), 8: (True, 1), 9: (True, 1)}
        if k == 0:
            index.compact()
    # compact() that is cut off leaves the old generation; a fresh handle tidies up.
    monkeypatch.setattr(index, "_is_whole", lambda name: name.endswith("1"))
    spark.sql(f"CREATE TABLE {index.name}_g000000007 (digest binary) USING parquet")
    again = exact_dedup.DigestIndex(spark, index.name)
    assert again.generations() == [again.table] and again.table.endswith("_g000000001")
    again.drop()


def test_old_files_go_by_the_anti_join(spark, docs):
    index = exact_dedup.new_index(spark)
    old = docs.where("doc_id < 60")
    first = exact_dedup.keep_new_of(old, index, ["a"])
    assert exact_dedup.keep_new_of(old, index, ["a"]).count() == first.count() > 0
    both = exact_dedup.keep_new_of(docs, index, ["b", "a"])
    assert both.join(first, "text", "left_semi").count() == 0 and both.count() > 0
    for k in range(2):
        exact_dedup.keep_new_of(old, index, [f"f{k}"])
    assert index.runs() == 0 and index.table.endswith("_g000000001")
    index.drop()


def test_keep_new(docs, clashing, empty, spark, rows):
    kept = exact_dedup.keep_new(clashing, exact_dedup.new_index(spark), "b")
    assert kept.columns == clashing.columns
    texts = [t(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({t(r[1]) for r in rows})
    assert exact_dedup.keep_new(empty, exact_dedup.new_index(spark), "b").count() == 0


# --- SimHash


def brute_components(items):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if (items[a][1] ^ items[b][1]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(items):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return Counter((i, f, least[find(k)]) for k, (i, f) in enumerate(items))


def slow_fingerprint(text):
    import re

    from xxhash import xxh64_intdigest

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_components(docs, clashing, rows):
    items = [(r[0], slow_fingerprint(t(r[1]))) for r in rows]
    want = brute_components(items)
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(clashing).collect())
    assert got == want
    assert any(n > 40 for n in Counter(c for _, _, c in want.elements()).values())


def brute_kept(rows):
    """(doc_id, text) of one row of each component: least doc_id, null last, then least digest."""
    items = [(r[0], slow_fingerprint(t(r[1]))) for r in rows]
    near = lambda a, b: (items[a][1] ^ items[b][1]).bit_count() <= 3
    left, kept = set(range(len(rows))), []
    while left:
        todo = [left.pop()]
        group = list(todo)
        while todo:
            a = todo.pop()
            more = {b for b in left if near(a, b)}
            left -= more
            todo += more
            group += more
        best = min(group, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, hashlib.sha256(t(rows[k][1]).encode()).digest()))
        kept.append((rows[best][0], t(rows[best][1])))
    return Counter(kept)


def test_simhash_keep_one(clashing, empty, rows):
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert Counter((r.doc_id, t(r.text)) for r in kept.collect()) == brute_kept(rows)
    assert simhash.keep_one(empty).count() == 0


def test_simhash_keep_one_by_row(spark):
    """Unlike texts under one doc_id stay, near copies without a doc_id go."""
    say = lambda seed, n: " ".join(f"w{(k * seed) % 997}" for k in range(n))
    rows = [(1, say(7, 80)), (1, say(11, 80)), (1, say(7, 80)), (2, say(11, 80)), (None, say(13, 80)), (None, say(13, 80)), (None, say(17, 80)), (5, say(17, 80))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, say(7, 80)), (1, say(11, 80)), (None, say(13, 80)), (5, say(17, 80))])


def test_hot_keys_are_dealt_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = 0x1234_5678_9ABC_DEF0
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 36, (400, 2))} | {int(x) for x in rng.integers(1 << 62, size=300)})
    frame = spark.createDataFrame([(f if f < 1 << 63 else f - (1 << 64),) for f in fps], "fp bigint")
    monkeypatch.setattr(simhash, "HOT_KEY", 30)
    monkeypatch.setattr(simhash, "CHUNK", 16)
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(frame).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    want = brute_components([(f, f) for f in fps])
    least = {f: c for f, _, c in want}
    assert all((find(a) == find(b)) == (least[a] == least[b]) for a in fps[::7] for b in fps[::5])


def test_bit_sliced_distances():
    rng = np.random.default_rng(3)
    fps = np.concatenate([rng.integers(1 << 63, size=150, dtype=np.uint64), np.uint64(1) << rng.integers(0, 63, 50, dtype=np.uint64)])
    near = simhash.within(fps, simhash.planes_of(fps))
    bits = np.unpackbits(near.astype(">u8").view(np.uint8), axis=1)[:, : len(fps)]
    want = np.array([[(int(a) ^ int(b)).bit_count() <= 3 for b in fps] for a in fps])
    assert (bits.astype(bool) == want).all()


# --- mixing


def brute_fill(cap, weight, budget):
    """Water filling in exact fractions, then rounded as the operator does."""
    from fractions import Fraction

    order = sorted(cap, key=lambda k: (Fraction(cap[k], weight[k]) if weight[k] else float("inf"), k))
    full, left, rest = set(), budget, sum(weight.values())
    for k in order:
        if weight[k] and cap[k] * rest <= weight[k] * left:
            full.add(k)
            left -= cap[k]
            rest -= weight[k]
        else:
            break
    out, upto = {}, 0
    for k in order:
        if k in full:
            out[k] = cap[k]
        else:
            out[k] = left * (upto + weight[k]) // rest - left * upto // rest if rest else 0
            upto += weight[k]
    return out


def test_mixture_budgets_and_prefixes(docs, rows):
    mix = mixing.Mixture(percent=130, epochs=2)
    narrow, cuts = mixing.plan_mixture(docs, mix)
    leaves = defaultdict(list)
    for i, text, lang, source, _ in rows:
        domain = "unknown" if source is None else "web" if len(source) <= 4 else "curated"
        leaves[domain, lang or "unknown", source or "unknown"].append((i, len(t(text).encode()) // 4 + 1))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    cap = lambda depth, under: {k: sum(tokens[x] * 2 for x in tokens if x[: depth + 1] == k) for k in {x[: depth + 1] for x in tokens if x[:depth] == under}}
    quotas = {(): min(sum(tokens.values()) * 130 // 100, 10**12)}
    for depth, names in enumerate((mix.domains, mix.langs, mix.sources)):
        after = {}
        for under, budget in quotas.items():
            c = cap(depth, under)
            after |= brute_fill(c, {k: names.get(k[-1], mix.other) for k in c}, budget)
        quotas = after
    got = {(r._lf_domain, r._lf_lang, r._lf_source): r for r in cuts.collect()}
    assert {k: r.quota for k, r in got.items()} == quotas
    copies = mixing.with_copies(narrow, cuts, mix).collect()
    for leaf, members in leaves.items():
        full, part = divmod(quotas[leaf], tokens[leaf])
        key = lambda i: (int(hashlib.md5(":".join([str(mix.seed), str(full), *([str(i)] if i is not None else [])]).encode()).hexdigest()[:15], 16), -(1 << 63) if i is None else i)
        size = Counter()
        for i, n in members:
            size[key(i)] += n
        upto, chosen = 0, set()
        for k in sorted(size):
            upto += size[k]
            if upto <= part:
                chosen.add(k)
        want = Counter((i, full + (key(i) in chosen)) for i, _ in members)
        assert Counter((r.doc_id, r._lf_copies) for r in copies if (r._lf_domain, r._lf_lang, r._lf_source) == leaf) == want


def test_mixture_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "l0", "a", 10), ("d0", "l0", "b", 1000), ("d0", "l1", "c", 1000), ("d1", "l0", "e", 1000)], "_lf_domain string, _lf_lang string, _lf_source string, tokens bigint")
    mix = mixing.Mixture(domains={}, langs={}, percent=20, epochs=1)
    got = {r._lf_source: r.quota for r in mixing.leaf_quotas(leaves, mix).collect()}
    assert sum(got.values()) == 3010 * 20 // 100 and got["a"] == 10
    assert abs(got["a"] + got["b"] - got["c"]) <= 1 and abs(got["a"] + got["b"] + got["c"] - got["e"]) <= 1


def brute_tree(tokens, levels, budget, epochs):
    """Leaf -> quota: ceilings bottom up over what has a weight, then water filling top down, family by family."""
    def cap(node):
        if levels[len(node) - 1].get(node[-1], 1) == 0 if node else False:
            return 0
        if len(node) == 3:
            return tokens[node] * epochs
        return sum(cap(c) for c in {x[: len(node) + 1] for x in tokens if x[: len(node)] == node})

    out = {}

    def fill(node, budget):
        if len(node) == 3:
            out[node] = budget
            return
        kids = {x[: len(node) + 1] for x in tokens if x[: len(node)] == node}
        for kid, got in brute_fill({c: cap(c) for c in kids}, {c: levels[len(node)].get(c[-1], 1) for c in kids}, budget).items():
            fill(kid, got)

    fill((), budget)
    return out


@pytest.mark.parametrize("zeros", [(), ("b", "c"), ("l0",), ("d1", "a"), ("a", "b", "c", "e", "f")])
def test_mixture_weights_of_zero(spark, zeros):
    tokens = {("d0", "l0", "a"): 900, ("d0", "l0", "b"): 5000, ("d0", "l0", "c"): 7000, ("d0", "l1", "e"): 2000, ("d1", "l0", "f"): 50_000, ("d1", "l1", "a"): 300}
    leaves = spark.createDataFrame([(*k, n) for k, n in tokens.items()], "_lf_domain string, _lf_lang string, _lf_source string, tokens bigint")
    weigh = lambda names: {k: 0 for k in zeros if k in names}
    levels = (weigh({"d0", "d1"}), weigh({"l0", "l1"}), weigh({"a", "b", "c", "e", "f"}))
    mix = mixing.Mixture(domains=levels[0], langs=levels[1], sources=levels[2], percent=60, epochs=1)
    got = {(r._lf_domain, r._lf_lang, r._lf_source): r.quota for r in mixing.leaf_quotas(leaves, mix).collect()}
    budget = sum(tokens.values()) * 60 // 100
    assert got == brute_tree(tokens, levels, budget, 1)
    assert all(got[k] == 0 for k in got if set(k) & set(zeros))
    room = sum(n for k, n in tokens.items() if not set(k) & set(zeros))
    assert sum(got.values()) == min(budget, room)


def test_mixture_fractional_weights(spark):
    leaves = spark.createDataFrame([("web", "l", "a", 10_000), ("curated", "l", "b", 10_000)], "_lf_domain string, _lf_lang string, _lf_source string, tokens bigint")
    quota = lambda domains: {r._lf_domain: r.quota for r in mixing.leaf_quotas(leaves, mixing.Mixture(domains=domains, langs={}, percent=50)).collect()}
    assert quota({"web": 0.6, "curated": 0.4}) == quota({"web": 3, "curated": 2}) == {"web": 6000, "curated": 4000}
    assert mixing.whole_weights({"a": 0.25, "b": 1}, 0.5) == ({"a": 1, "b": 4}, 2)
    with pytest.raises(ValueError):
        mixing.whole_weights({"a": -1}, 1)


@pytest.mark.parametrize("bin_rows", [1, 50_000])
def test_mixture_without_ids(spark, monkeypatch, bin_rows):
    """Rows without a doc_id, or that share one, are chosen each for itself, up to the quota."""
    monkeypatch.setattr(mixing, "BIN_ROWS", bin_rows)
    rows = [(None if k % 2 else 7, f"text number {k}", "en", "s", 1) for k in range(200)] + [(1000 + k, f"other {k}", "en", "t", 1) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mix = mixing.Mixture(percent=50)
    narrow, cuts = mixing.plan_mixture(docs, mix)
    quotas = {r["_lf_source"]: r.quota for r in cuts.collect()}
    kept = mixing.mix_documents(docs, mix).collect()
    for source, quota in quotas.items():
        tokens = sum(len(r.text) // 4 + 1 for r in kept if r.source == source)
        assert quota - 6 < tokens <= quota and quota > 300
    assert len({r.text for r in kept if r.doc_id is None}) > 20 and any(r.doc_id == 7 for r in kept)


def test_mixture_documents(clashing, empty):
    out = mixing.mix_documents(clashing, mixing.Mixture())
    assert out.columns == clashing.columns and out.count() > 0
    assert mixing.mix_documents(empty, mixing.Mixture()).count() == 0


# --- PII


def test_pseudonyms_keep_format_and_link():
    text = "mail Jane.Doe7@mail.example.com or card 4111 1111 1111 1111, born 1987-05-12, ip 10.0.200.3, call +1 (017) 555-7713."
    out, found = pii.pseudonymised(text, b"key")
    assert found == {"email": 1, "card": 1, "iban": 0, "ssn": 0, "date": 1, "ip": 1, "phone": 1}
    assert "Jane.Doe7" not in out and "4111 1111 1111 1111" not in out and "1987-05-12" not in out
    shape = lambda s: "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in s)
    before, after = text.replace("10.0.200.3", "IP"), out
    assert shape(before.split("ip")[0]) == shape(after.split("ip")[0])
    again, _ = pii.pseudonymised("x " + text + " y", b"key")
    assert again == "x " + out + " y"
    assert pii.pseudonymised(text, b"other")[0] != out
    card = "".join(c for c in out.split("card ")[1][:19] if c.isdigit())
    assert pii.luhn_digit(card[:-1]) == card[-1]


def test_unvalidated_numbers_stay():
    for text in ("4111 1111 1111 1112", "2023-02-30", "300.1.1.1", "Version 2.0.1", "order 1234567", "", "no digits @ all", "sha 04dbebab91ab85687d33eeaaf9ac699e1188f962"):
        assert pii.pseudonymised(text, b"k") == (text, dict.fromkeys(pii.KINDS, 0))


@pytest.mark.parametrize(
    "text, private, kind",
    [
        ("pay 4111 1111 1111 1111 12/27 now", "4111 1111 1111 1111", "card"),
        ("pay 4111 1111 1111 1111 123", "4111 1111 1111 1111", "card"),
        ("no. 12 4111 1111 1111 1111", "4111 1111 1111 1111", "card"),
        ("4111 1111 1111 1111 5@x.com", "4111 1111 1111 1111", "card"),
        ("ES91 2100 0418 4502 0005 1332 EUR", "ES91 2100 0418 4502 0005 1332", "iban"),
        ("ES9121000418450200051332 BANK", "ES9121000418450200051332", "iban"),
        ("ES91 2100 0418 4502 0005 1332 PAID NOW", "ES91 2100 0418 4502 0005 1332", "iban"),
        ("Order DE12 4111 1111 1111 1111", "4111 1111 1111 1111", "card"),
        ("card:4111111111111111 2 items", "4111111111111111", "card"),
        ("at 1984-03-12T10:00:00Z", "1984-03-12", "date"),
        ("born 03/25/1990.", "03/25/1990", "date"),
    ],
)
def test_private_data_beside_other_things(text, private, kind):
    out, found = pii.pseudonymised(text, b"k")
    alone, _ = pii.pseudonymised(private, b"k")
    assert found[kind] == 1 and alone != private
    assert out.split("@")[0][:-1] == text.replace(private, alone).split("@")[0][:-1] if "@" in text else out == text.replace(private, alone)


def test_month_first_dates_stay_so():
    for day in range(13, 32):
        out, _ = pii.pseudonymised(f"01/{day}/1990", b"k")
        month, other, year = out.split("/")
        assert 1 <= int(month) <= 12 < int(other) and len(year) == 4
    assert pii.pseudonymised("02/30/1990", b"k")[0] == "02/30/1990"


def test_values_are_linked_across_forms():
    """One date in four forms, one number in several spacings: the same pseudonym in each."""
    import datetime
    import re

    cipher = pii.Cipher(b"some key")
    for k in range(0, 40_000, 20):
        d = datetime.date(1930, 1, 1) + datetime.timedelta(k)
        new = pii._ymd(f"{d:%Y-%m-%d}", cipher)
        assert pii._dmy(f"{d:%d/%m/%Y}", cipher) == "/".join(reversed(new.split("-")))
        if d.day > 12:
            y, m, day = new.split("-")
            assert pii._dmy(f"{d:%m/%d/%Y}", cipher) == f"{m}/{day}/{y}" and int(day) > 12
    forms = ["+34600123456", "+34 600 123 456", "+34 600-12-34-56", "+346 00123456"]
    assert len({re.sub(r"\D", "", pii._phone(f, cipher)) for f in forms}) == 1
    assert all(pii._phone(f, cipher).startswith("+34") and "600123456" not in re.sub(r"\D", "", pii._phone(f, cipher)) for f in forms)


def test_long_local_parts_change_throughout():
    local = "abcdefghij" * 60
    out, found = pii.pseudonymised(f"to {local}@mail.example.com", b"k")
    got = out[3 : 3 + len(local)]
    assert found["email"] == 1 and out[3 + len(local)] == "@"
    assert all(got[k : k + 20] != local[k : k + 20] for k in range(0, len(local), 20))
    assert pii.pseudonymised("a@b.com+xyzxyz@c.org", b"k")[1]["email"] == 2


@pytest.mark.parametrize("size", [2, 10, 73049, 10**15, 1 << 32, 36**20])
def test_feistel_is_a_permutation(size):
    values = range(size) if size <= 10 else [0, 1, size // 3, size - 1]
    out = [pii.feistel(v, size, b"k", "x") for v in values]
    assert len(set(out)) == len(out) and all(0 <= x < size for x in out)
    assert [pii.feistel(x, size, b"k", "x", inverse=True) for x in out] == list(values)


def test_pseudonymise_rows(clashing, empty, rows):
    got = pii.pseudonymise(clashing, b"k")
    back = got.select("doc_id", "text").transform(lambda d: pii.pseudonymise(d, b"k", inverse=True))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t(x)) for i, x, *_ in rows)
    assert pii.pseudonymise(empty, b"k").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymised("a@b.org", b"")


def plain_feistel(value, bits, key, kind, size):
    """Eight rounds over two halves, as the docstring says, until the number is below size."""
    while True:
        a, b = value >> bits, value % 2**bits
        for r in range(8):
            n = (bits + 7) // 8
            h = hashlib.blake2b(b.to_bytes(n, "big"), key=key, person=f"{kind}:{r}:{size % 997}".encode(), digest_size=n + 8).digest()
            a, b = b, a ^ int.from_bytes(h, "big") % 2**bits
        value = a * 2**bits + b
        if value < size:
            return value


def plain_check_digit(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str((10 - total % 10) % 10)


def test_planted_values_by_a_finder_of_its_own(spark):
    """Mail addresses, cards, numeric addresses and phones of the supplied documents, found by plain patterns: each is gone,
    and cards and numeric addresses have become what a Feistel network written anew makes of them."""
    import re

    import pandas as pd

    texts = dict(pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[["doc_id", "text"]].itertuples(index=False))
    out = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), b"key").collect()}
    found, gone, right = Counter(), Counter(), Counter()
    for i, text in texts.items():
        for m in re.finditer(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", text or ""):
            found["mail"] += 1
            gone["mail"] += m[0] not in out[i]
        for m in re.finditer(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])", text or ""):
            parts = [int(x) for x in m[0].split(".")]
            if max(parts) < 256:
                found["ip"] += 1
                n = plain_feistel(int.from_bytes(bytes(parts), "big"), 16, b"key", "ip", 2**32)
                gone["ip"] += m[0] not in out[i]
                right["ip"] += ".".join(map(str, n.to_bytes(4, "big"))) in out[i]
        for m in re.finditer(r"(?<![\d-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\d)", text or ""):
            digits = re.sub(r"\D", "", m[0])
            if plain_check_digit(digits[:-1]) == digits[-1]:
                found["card"] += 1
                body = f"{plain_feistel(int(digits[:-1]), 25, b'key', 'card', 10**15):015d}"
                it = iter(body + plain_check_digit(body))
                gone["card"] += m[0] not in out[i]
                right["card"] += "".join(next(it) if c.isdigit() else c for c in m[0]) in out[i]
        for m in re.finditer(r"\+\d{1,3}[ -]\(?\d{2,4}\)?[ -]\d{3}[ -]?\d{4}", text or ""):
            found["phone"] += 1
            gone["phone"] += m[0] not in out[i]
    assert sum(found.values()) > 50
    assert all(gone[k] >= 0.99 * found[k] for k in found) and all(right[k] >= 0.99 * found[k] for k in ("ip", "card"))
    back = pii.pseudonymise(spark.createDataFrame(list(out.items()), "doc_id bigint, text string"), b"key", inverse=True)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t(x) for i, x in texts.items()}


@pytest.mark.parametrize("text", ["josé@mail.example.com", "ñandú.Ελένη@exämple.org", "日本@例え.jp", "ŁÓDŹ-7@x.org", "e\u0301te\u0301@x.org"])
def test_letters_of_any_script_are_permuted(text):
    out, found = pii.pseudonymised(text, b"k")
    assert found["email"] == 1 and out != text and pii.pseudonymised(out, b"k", inverse=True)[0] == text


def test_keys_count_whole():
    long = b"x" * 80
    assert pii.pseudonymised("jane.doe@mail.org", long + b"1")[0] != pii.pseudonymised("jane.doe@mail.org", long + b"2")[0]


# --- quality classifier


def test_classifier_learns_and_ignores_held_out(spark):
    good = [(k, "the sea and the river of stone " * 5 + f"word{k}", 1) for k in range(400)]
    bad = [(k, "BUY!! NOW!! " * 12 + f"X{k}", 0) for k in range(400, 480)]
    docs = spark.createDataFrame([(i, x) for i, x, _ in good + bad] + [(900, None), (None, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(1, 1), (None, 1), (2, None)], "doc_id bigint, quality int")
    weights = quality_model.train(docs, labels)
    flipped = labels.withColumn("quality", F.when(quality_model.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality_model.train(docs, flipped) == weights).all()
    scores = {r.doc_id: r._lf_score for r in quality_model.score(docs, weights).collect()}
    assert all(scores[i] >= 0.5 for i, _, _ in good) and all(scores[i] < 0.3 for i, _, _ in bad)
    assert len(scores) == 482 and 0 < scores[900] < 1


def test_classifier_with_more_words_than_the_memory(monkeypatch):
    texts = ["one two three one", "four five six seven eight four", "", "one nine ten", "two six", "one two three one"]
    roomy = quality_model.Features()
    want = [roomy.places(words) for words in roomy.lists(texts)]
    monkeypatch.setattr(quality_model, "CACHE_WORDS", 4)
    small, whole = quality_model.Features(), quality_model.Features()
    together = [whole.places(words) for words in whole.lists(texts)]  # a slice over the bound
    got = list(small.each(texts))
    assert all((a == b).all() for found in (got, together) for x, y in zip(found, want, strict=True) for a, b in zip(x, y, strict=True))
    assert len(small.known) <= 4
    again = whole.lists(["eleven twelve", "one"])  # another slice after the one over the bound
    assert [len(whole.places(w)[0]) for w in again] == [2, 1] and len(whole.known) == 3


def plain_vector(text):
    """Place -> amount, from the docstring: four families of n-grams, each weighing 1 in all, and the bias."""
    from itertools import groupby, pairwise

    from xxhash import xxh64_intdigest

    def sign(c):
        return "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c

    words = text.split()
    names = [xxh64_intdigest(w.lower(), 1) for w in words]
    shapes = [xxh64_intdigest("".join(k for k, _ in groupby(map(sign, w))), 2) for w in words]
    place = lambda h: 2 + (h % 2**64 >> 40) % (2**18 - 2)
    families = [
        [place(h) for h in names],
        [1 if a == b else place(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) for a, b in pairwise(names)],
        [place(h) for h in shapes],
        [place(a * 0xD6E8FEB86659FD93 + b * 0xA0761D6478BD642F) for a, b in pairwise(shapes)],
    ]
    out = defaultdict(float)
    out[0] = 1.0
    for family in families:
        for at in family:
            out[at] += 1 / len(family)
    return out


def logistic(x):
    return 1 / (1 + np.exp(-x))


def test_classifier_scores_by_brute_force(docs, rows):
    rng = np.random.default_rng(0)
    weights = rng.normal(size=quality_model.PLACES).astype(np.float32)
    want = Counter()
    for i, text, *_ in rows:
        want[i, round(float(logistic(sum(float(weights[at]) * v for at, v in plain_vector(t(text)).items()))), 6)] += 1
    assert Counter((r.doc_id, round(r._lf_score, 6)) for r in quality_model.score(docs, weights).collect()) == want


def test_classifier_updates_by_brute_force(spark):
    """Follow the regularised leader, written plainly, over two passes in the sample's order."""
    import math

    rows = [(k, f"good words {k % 5} here" if k % 3 else f"BAD!! {k % 4} $$", int(k % 3 > 0)) for k in range(60)]
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows] + [(7, "zzz a later text of the same id")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    order = {r.doc_id: r.o for r in labels.select("doc_id", F.xxhash64("doc_id").alias("o")).collect()}
    learned = [r for r in sorted(rows, key=lambda r: order[r[0]]) if zlib.crc32(str(r[0]).encode()) % 5]
    z, n = defaultdict(float), defaultdict(float)

    def weight(at):
        return 0.0 if abs(z[at]) <= 1e-4 else -(z[at] - math.copysign(1e-4, z[at])) / ((1 + math.sqrt(n[at])) / 0.5 + 1e-3)

    for _ in range(2):
        for _, text, label in learned:
            vector = {at: float(np.float32(v)) for at, v in plain_vector(text).items()}
            now = {at: weight(at) for at in vector}
            off = logistic(sum(now[at] * v for at, v in vector.items())) - label
            for at, v in vector.items():
                g = off * v
                z[at] += g - (math.sqrt(n[at] + g * g) - math.sqrt(n[at])) / 0.5 * now[at]
                n[at] += g * g
    want = np.zeros(quality_model.PLACES)
    for at in list(z):
        want[at] = weight(at)
    assert np.allclose(quality_model.train(docs, labels), want, atol=1e-5) and np.abs(want).max() > 0.1


def test_classifier_without_labels(clashing, empty, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    weights = quality_model.train(clashing, none)
    kept = quality_model.keep_good(clashing, none)
    assert not weights.any() and kept.columns == clashing.columns and kept.count() == clashing.count()
    assert quality_model.score(empty, weights).count() == 0


# --- chat


CONTROL = ["<|im_end|>", "&lt;|", "&amp;lt;|", "<", "<|", "a & b", "<|im_start|>assistant\nx", "", None, "é<|日", "x" * 5000, "\\n\n\n"]


def test_chat_round_trip(spark):
    rows = [(c, k, role, CONTROL[(c * 5 + k) % len(CONTROL)]) for c in range(30) for k, role in enumerate((["system"] if c % 3 == 0 else []) + ["user", "assistant"] * (c % 9 + 1))]
    rows += [(77, 0, None, "no role"), (77, 1, "odd\nrole <|&", "x"), (77, 1, "odd\nrole <|&", "x"), (None, 0, "assistant", "no id")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    windows = chat.format_windows(frame, stride=64, history=40)
    assert windows.where("n_repeated > 0").count() > 0
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by = defaultdict(list)
    for c, k, role, text in rows:
        by[c].append((k, t(role), t(text)))
    for c, turns in by.items():
        turns.sort()
        assert [(r.role, r.text) for r in got[c].turns] == [(a, b) for _, a, b in turns]
        assert list(got[c].loss) == [b for _, a, b in turns if a == "assistant"]
    assert set(got) == set(by)
    for w in windows.collect():
        for start, length in w.loss_spans:
            assert w.text[:start].endswith("<|im_start|>assistant\n") and w.text[start + length :].startswith(chat.END)


def test_chat_clashing_columns(spark):
    """Columns named like the operator's own, and texts and turns without a value."""
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, None, None, "first"), (1, 2, "assistant", "y" * 30_000), (2, 0, "assistant", "")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    odd = frame.withColumns({c: F.lit("x") for c in ("idx", "head", "body", "piece", "system", "cost", "at", "raw", "new", "own", "last", "window", "m", "first_at", "n")})
    plain, other = ({r.conv_id: r for r in chat.read_back(chat.format_windows(f)).collect()} for f in (frame, odd))
    assert plain == other and [x.text for x in plain[1].turns] == ["first", "s", "", "y" * 30_000]


def test_chat_empty(spark):
    assert chat.read_back(chat.format_windows(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0


# --- BPE


POOL = ["'s", "'re", "don't", "ΑΣ", "ς", "İ", "ﬁ", "é", "e\u0301", "\u0301", "中文字", "a", "aaaa", "the", "ing", " ", "\n", "\x1c", "\x85", "\xa0", "\u2003", "1", "½", "Ⅷ", "_", "<|", "<|endoftext|>", "</w>", "👍🏽", "ß", "K", "한국", "\0", "\ufeff", "qu", "zz", "thonon"]


@pytest.fixture(scope="session")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_codec_matches_the_library(library):
    import random

    rng, own, enc = random.Random(5), bpe.Codec(bpe.vocabulary_path()), token_files.Encoder(bpe.vocabulary_path())
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randrange(14))) for _ in range(3000)]
    for text, a, b in zip(texts, own.encode_batch(texts), enc.encode_batch(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        ids = np.frombuffer(a, own.width)
        assert ids.tolist() == want and a == b
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_very_long_words(library):
    """Words beyond and about the limit of merging side by side; a million letters take seconds."""
    import random
    import time

    rng, own = random.Random(3), bpe.Codec(bpe.vocabulary_path())
    words = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "etaoinshrdlu", "é日x", "a") for n in (510, 511, 512, 513, 3000, 40_000)]
    for word, a in zip(words, own.encode_batch(words), strict=True):
        assert np.frombuffer(a, own.width).tolist() == library.encode(word, add_special_tokens=False).ids
    own, begun = bpe.Codec(bpe.vocabulary_path()), time.time()
    (ids,) = own.encode_batch(["".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))])
    assert len(ids) > 400_000 and time.time() - begun < 60


def test_pairs_against_exact_merges(library):
    own = bpe.Codec(bpe.vocabulary_path())
    rng = np.random.default_rng(2)
    inner = np.array([i for t_, i in own.by_text.items() if not t_.endswith(bpe.END)])
    left, right = rng.choice(inner, 800), rng.choice(np.array(list(own.by_text.values())), 800)
    texts = {i: t_ for t_, i in own.by_text.items()}
    fits = own.compatible(left, right)
    words = [texts[a] + (texts[b] if texts[b].endswith(bpe.END) else texts[b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    ended = [k for k, w in enumerate(words) if w.endswith(bpe.END)]
    exact = own.merged([words[k] for k in ended])
    for k, ids in zip(ended, exact, strict=True):
        assert (ids.tolist() == [left[k], right[k]]) == bool(fits[k])
    assert len(ended) > 100 and 0 < fits[ended].sum() < len(ended)


def test_encode_rows(clashing, empty, rows, library):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in bpe.encode(clashing, bpe.vocabulary_path()).collect())
    want = Counter()
    for i, text, *_ in rows:
        ids = library.encode(t(text), add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), tuple(ids)] += 1
    assert got == want
    assert bpe.encode(empty, bpe.vocabulary_path()).count() == 0


def test_token_files(clashing, empty, rows, library, spark):
    folder = scratch(spark, "tokens")
    manifest = token_files.write_shards(clashing, bpe.vocabulary_path(), folder, sequence=64, batch=4)
    got = sorted((r.start, r.n_tokens, r.ids_crc32, r.doc_id) for r in token_files.read_documents(manifest).collect())
    want, at = [], 0
    for i, text, *_ in sorted(rows, key=lambda r: shard_key(r[0], t(r[1]))):
        ids = library.encode(t(text), add_special_tokens=False).ids + [2]
        want.append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), i))
        at += len(ids)
    assert got == want
    shard = manifest.first()
    reader = token_files.ShardReader(shard.tokens_path)
    ids, mask = reader.example(0)
    assert len(ids) == 64 and not ids.flags.owndata and np.unpackbits(mask).sum() == min(64, shard.n_tokens)
    assert token_files.read_documents(token_files.write_shards(empty, bpe.vocabulary_path(), folder + "-none")).count() == 0


# --- quality rules


def slow_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    marked = {k + j for k, g in enumerate(grams) if g in twice for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), len(lines)


def test_text_counts(rows):
    import random

    rng = random.Random(4)
    extra = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(300)]
    for text in [t(r[1]) for r in rows] + extra:
        assert quality_rules.text_counts(text.encode()) == slow_counts(text)


def test_bins(spark):
    values = [*range(600), 1000, 4095, 4096, 10**6, 10**12]
    frame = spark.createDataFrame([(v,) for v in values], "v bigint").withColumn("b", quality_rules.bin_of("v")).withColumn("s", quality_rules.bin_start("b"))
    for r in frame.collect():
        assert r.s == slow_bin(r.v) and r.s <= r.v <= r.s * 129 / 128 + 0.01
    assert [r.b for r in frame.orderBy("v").collect()] == sorted(r.b for r in frame.collect())


def slow_bin(v):
    p = max(0, v.bit_length() - 8)
    return v >> p << p


def slow_rates(counted):
    n, chars, symbols, dup, rep, lines = counted
    return {"word_length": chars * 100 // n if n else 0, "symbols": symbols * 1000 // chars if chars else 0, "dup_lines": dup * 1000 // lines if lines else 0, "repeats": rep * 1000 // n if n else 0}


def slow_limits(values, form):
    """(low, high) of one rate's values, by sorting them."""
    v = sorted(map(slow_bin, values))
    at = lambda k: v[-(-len(v) * k // 1000) - 1]
    reach = form[1] * (at(750) - at(250))
    if form[0] == "fence":
        return max(0, at(250) - reach), at(750) + reach
    q = at(form[2])
    return 0, max(at(750) + reach, q + sum(max(0, x - q) for x in v) * 1000 * form[3] // (len(v) * 4 * (1000 - form[2])))


def slow_verdicts(rows):
    """Per row: base_failed, kept; rows are (text, lang, source)."""
    counted = [slow_counts(x) for x, *_ in rows]
    failed = [c[0] < 20 or 100 * c[4] > 30 * c[0] for c in counted]
    rates = [slow_rates(c) for c in counted]
    groups = defaultdict(list)
    for k, (_, lang, source) in enumerate(rows):
        if not failed[k]:
            for g in ((), (lang,), (lang, source)):
                groups[g].append(k)
    limits = {}
    for name, spec in quality_rules.RATES.items():
        for g in sorted(groups, key=len):
            n, own = len(groups[g]), slow_limits([rates[k][name] for k in groups[g]], spec[3])
            limits[g, name] = own if not g else tuple((n * a + 50 * b) // (n + 50) for a, b in zip(own, limits[g[:-1], name], strict=True))
    return [(bad, not bad and all(limits[(lang, source), r][0] <= rates[k][r] <= limits[(lang, source), r][1] for r in rates[k])) for k, (bad, (_, lang, source)) in enumerate(zip(failed, rows, strict=True))], limits


def test_rules_verdicts(clashing, empty, rows):
    got = quality_rules.judged(clashing).collect()
    want, _ = slow_verdicts([(t(x), lang, source) for _, x, lang, source, _ in rows])
    assert Counter((r.doc_id, r.n_words, r.base_failed, r.kept) for r in got) == Counter((r[0], slow_counts(t(r[1]))[0], *v) for r, v in zip(rows, want, strict=True))
    assert quality_rules.judged(empty).count() == 0


def test_limits_follow_their_group(spark):
    """A group whose texts are full of signs has limits of its own; texts that stand out from a plain group go."""
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))
    plain = lambda share: " ".join(word() + ("#$" if rng.random() < share else "") for _ in range(60))
    rows = [(k, plain(0.0), "en", "prose") for k in range(400)] + [(1000 + k, plain(0.5), "en", "code") for k in range(400)]
    rows += [(2000 + k, plain(0.5), "en", "prose") for k in range(8)] + [(3000 + k, plain(0.5), "de", "tiny") for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = {(r.lang_key, r.source_key): r for r in quality_rules.thresholds(quality_rules.counts(frame)).collect()}
    assert found["=en", "=code"].high_symbols > 3 * found["=en", "=prose"].high_symbols
    want, limits = slow_verdicts([r[1:] for r in rows])
    for (lang, source), r in found.items():
        for name in quality_rules.RATES:
            assert limits[(lang[1:], source[1:]), name] == (r[f"low_{name}"], r[f"high_{name}"])
    kept = {r.doc_id: r.kept for r in quality_rules.judged(frame).collect()}
    assert kept == {r[0]: v[1] for r, v in zip(rows, want, strict=True)}
    assert not any(kept[2000 + k] for k in range(8))
    assert sum(kept[k] for k in range(400)) > 390 and sum(kept[1000 + k] for k in range(400)) > 390


# --- sharding


def shard_key(i, text):
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(text.encode(), 42)
    return -(1 << 63) if i is None else i, h - (1 << 64) if h >= 1 << 63 else h


@pytest.mark.parametrize("piece_bytes", [1 << 30, 3000, 500])
def test_sharding_by_bytes(clashing, empty, rows, piece_bytes):
    placed = sharding.shard_documents(clashing, shards=6, piece_bytes=piece_bytes)
    assert placed.columns == [*clashing.columns, "_lf_slot", "_lf_shard"]
    got = placed.collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in got) == Counter((r[0], r[1], "x", "x") for r in rows)
    total = sum(len(t(r[1]).encode()) + 8 for r in rows)
    sizes = Counter()
    for i, text, *_ in rows:
        sizes[shard_key(i, t(text))] += len(t(text).encode()) + 8
    below, at = {}, 0
    for k in sorted(sizes):
        below[k] = at
        at += sizes[k]
    assert all(r._lf_shard == 6 * below[shard_key(r.doc_id, t(r.text))] // total for r in got)
    for shard in range(6):
        own = sorted((r._lf_slot, shard_key(r.doc_id, t(r.text))) for r in got if r._lf_shard == shard)
        assert [x for x, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)
    assert sharding.shard_documents(empty).count() == 0


def test_rows_that_share_a_doc_id_are_split(spark):
    rows = [(None, f"no id {k}") for k in range(300)] + [(5, f"five {k}") for k in range(300)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=6, piece_bytes=100).collect()
    sizes = Counter()
    for r in got:
        sizes[r._lf_shard] += len(r.text) + 8
    assert len(sizes) == 6 and max(sizes.values()) - min(sizes.values()) <= 40


@pytest.mark.parametrize("keys", [[5] * 10, [-(1 << 63), (1 << 63) - 1, 0], list(range(0, 1 << 40, 1 << 33)), [k * k * k for k in range(-200, 200)]])
def test_splitters(spark, keys):
    both = [(k, (k * 7919 * (n + 1)) % (1 << 63) - (1 << 62)) for n, k in enumerate(keys)]
    frame = spark.createDataFrame([(k, h, 1 + n % 7) for n, (k, h) in enumerate(both)], "_lf_key bigint, _lf_hash bigint, _lf_size bigint")
    total = sum(1 + n % 7 for n in range(len(keys)))
    cuts = sharding.splitters(frame, 5)
    pieces = dict(((r._lf_key, r._lf_hash), r.p) for r in frame.select("*", sharding.piece_of(cuts).alias("p")).collect())
    for at in both:
        below = sum(1 + n % 7 for n, x in enumerate(both) if x < at)
        number = (at[0] + (1 << 63)) << 64 | (at[1] + (1 << 63))
        assert sum(c <= number for c in cuts) == sum(below * 5 >= j * total for j in range(1, 5)) == pieces[at]
