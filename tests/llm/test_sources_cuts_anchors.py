"""Divergence of sources, fill-in-middle and syncmer fingerprints against brute force and SQL."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtext.llm import divergence, fim, queries, syncmers

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", None, None), (3, "  \n\t ", None, "s", 5), (4, "one", "en", "s", 3), (4, "one", "en", "s", 3), (5, "word " * 30000, "en", "s", 150000), (None, "no id at all", "fr", "t", 12), (6, "a <P> in it", "en", "s", 11), (7, "Žluťoučký 漢字かな \U0001f600 kůň", "fr", "t", 20)]
UNIT = re.compile(r"[^\W\d_a-zA-Z]|.", re.S)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    extra = ["th", "tl", "id", "n", "term", "form", "block", "output", "anchors", "range_no", "guest", "value", "h1", "docs"]
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same_as_sql(df, name, path):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.sql(queries.ORACLES[name])
    got = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    assert got == sorted(map(repr, want.project(", ".join(sorted(df.columns))).fetchall()))
    return len(got)


# --- source divergence


def audited(rows, min_docs, top=50):
    """Brute force in Python's whole numbers: (lang, source, part, item, value, rank)."""
    terms = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {x for x, _, _ in terms}:
        held = collections.Counter(t for x, _, ts in terms if x == lang for t in set(ts))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        count = collections.defaultdict(collections.Counter)
        whole = collections.Counter()
        for x, source, ts in terms:
            if x == lang:
                count[source].update(t for t in ts if held[t] >= min_docs)
                whole.update(t for t in ts if held[t] >= min_docs)

        def p(c, t, v=len(kept)):
            return 1 + 1_000_000_000 * (c[t] + 5) // (c.total() + 5 * v)

        for s in count:
            pairs = [(o, sum(abs(p(count[s], t) - p(count[o], t)) for t in kept)) for o in count if o != s]
            above = [(t, p(count[s], t) - p(whole, t)) for t in kept if count[s][t] and p(count[s], t) > p(whole, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", above, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize(("block", "chunk", "run"), [(64, 4096, 64), (3, 7, 2), (1, 1, 1)])
def test_tiles_of_any_size_give_the_same(spark, docs, monkeypatch, block, chunk, run):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("CHUNKS_A_TASK", run), ("HELD_TERMS", 50 * block), ("PIECE", 16 * block)):
        monkeypatch.setattr(divergence, name, value)
    rows = docs.select("text", "lang", "source").limit(200 if block == 64 else 60)
    got = sorted(tuple(r) for r in divergence.divergence(rows, min_docs=4).collect())
    assert got == audited([tuple(r) for r in rows.collect()], 4)


def test_shares_are_exact_beyond_64_bits(spark):
    rng = random.Random(3)
    for _ in range(300):
        total = rng.randrange(1, 9 * 10 ** rng.randrange(1, 16))
        counts = [rng.randrange(total + 1) for _ in range(5)]
        assert divergence.shares(np.array(counts), total + 5).tolist() == [1 + 10**9 * (c + 5) // (total + 5) for c in counts]
    with pytest.raises(OverflowError):
        divergence.shares(np.array([1]), 10**16)
    big = spark.createDataFrame([(7 * 10**13, 9 * 10**14)], "c long, n long").select(divergence.share(F.col("c"), F.col("n"), F.lit(1000))).first()[0]
    assert big == 1 + 10**9 * (7 * 10**13 + 5) // (9 * 10**14 + 5000)


def test_divergence_odd(odd, empty):
    got = sorted(tuple(r) for r in divergence.divergence(odd, min_docs=2).collect())
    assert got == audited([(t, lang, s) for _, t, lang, s, _ in ODD], 2)
    assert ("en", "", "pair", "s", got[0][4], 1) in got and divergence.divergence(empty).count() == 0
    # Nothing is kept: distances are 0, in the order of the names.
    assert {r["value"] for r in divergence.divergence(odd, min_docs=99).collect()} == {0}


def test_divergence_against_sql(spark):
    assert same_as_sql(divergence.op11_source_divergence(spark, SF), "op11_source_divergence", f"{SF}/documents.parquet") > 1000


# --- fill-in-middle


def cut(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_cuts_equal_cuts_by_hand(spark, docs, odd, empty):
    rng = random.Random(4)
    made = [(k, "".join(rng.choice("aé漢\U0001f600 \n<S>P") for _ in range(rng.randrange(40)))) for k in range(400)]
    for df in (docs, odd, spark.createDataFrame(made, "doc_id long, text string")):
        texts = sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)
        rows = fim.restore(fim.transform(df)).collect()
        got = sorted(((r["doc_id"], r["restored"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows), key=repr)
        assert got == sorted(((i, t or "", *cut(i, t)) for i, t in texts), key=repr)
    assert fim.restore(fim.transform(empty)).count() == 0


def test_forms_all_occur(docs):
    forms = collections.Counter(r["form"] for r in fim.transform(docs).collect())
    assert set(forms) == {"plain", "psm", "spm"} and forms["psm"] > forms["spm"] > 0


@pytest.mark.parametrize(("unit", "pattern"), [("codepoint", r"(?s)."), ("word", r"\s*\S+|\s+"), ("line", r"[^\n]*\n|[^\n]+")])
def test_units(unit, pattern):
    rng = random.Random(5)
    texts = ["", " ", "\n", "é", "ab  cd\nef "] + ["".join(rng.choice("aé漢 \n") for _ in range(rng.randrange(30))) for _ in range(200)]
    column = pa.array(texts)
    raw, off = fim.buffers(column)
    so_far, before, n = fim.unit_counts(raw, off, unit)
    pieces = [re.findall(pattern, t) for t in texts]
    if unit == "word":  # a blank run starts a word; a break is a blank here
        pieces = [re.findall(r"\s+\S*|\S+", t) for t in texts]
        firm = [k for k, t in enumerate(texts) if not re.search(r"\s\s", t)]
    else:
        firm = range(len(texts))
    for k in firm:
        assert n[k] == len(pieces[k]), texts[k]
        for c in range(len(pieces[k]) + 1):
            at = fim.cut_bytes(so_far, before, off, np.full(len(texts), c))[k] - off[k]
            assert texts[k].encode()[:at].decode() == "".join(pieces[k][:c])


def test_a_unit_must_be_known(docs):
    with pytest.raises(ValueError, match="unit"):
        fim.transform(docs, unit="page")


def test_fill_in_middle_against_sql(spark):
    assert same_as_sql(fim.op12_fill_in_middle(spark, SF), "op12_fill_in_middle", f"{SF}/documents.parquet") == 200


# --- syncmers


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chained(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed)
        if len(values) > 1:
            v = None
    return signed(seed)


def anchors_by_hand(text):
    import regex

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    units = [chained(x) for x in regex.findall(r"\p{Lo}|[^\x20\x09-\x0D\p{Lo}]{1,8}", low)]
    if not units:
        return []
    if len(units) < 5:
        return [(chained(" ".join(map(str, units))) % 2**64 >> 36, 0)]
    inner = [chained(a, b) for a, b in zip(units, units[1:])]
    out = []
    for i in range(len(units) - 4):
        w = inner[i : i + 4]
        if min(w) in (w[0], w[3]):
            out.append((chained(w[0], w[2], w[3]) % 2**64 >> 36, i))
    return out


def likeness_by_hand(a, b):
    if a == b:
        return 1.0
    z = sorted([(h, p, 0) for h, p in a] + [(h, p, 1) for h, p in b])
    pairs = [(k, (y[1] - x[1]) * (1 if x[2] == 0 else -1)) for k, (x, y) in enumerate(zip(z, z[1:])) if x[0] == y[0] and x[2] != y[2]]
    votes = collections.Counter(d for _, d in pairs)
    covered = {j for k, d in pairs if d == 0 or votes[d] > 1 for j in (k, k + 1)}
    return len(covered) / len(z)


def rendered(anchors):
    before, out = -1, ""
    for h, p in anchors:
        out += f"{p - before:x}{h:07x}"
        before = p
    return out


def by_hand(texts):
    out = []
    for k, t in enumerate(texts):
        follow, third = texts[(k + 1) % len(texts)], len(t) // 3
        e = t[: len(t) - third] + follow[:third]
        a, b, c = anchors_by_hand(t), anchors_by_hand(e), anchors_by_hand(follow)
        out.append((len(t), hashlib.sha256(e.encode()).hexdigest(), rendered(a), rendered(b), round(likeness_by_hand(a, b), 9), round(likeness_by_hand(a, c), 9)))
    return out


def fingerprinted(df):
    rows = syncmers.edited(df).select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("sha"), syncmers.fingerprint(F.col("anchors")).alias("f"), syncmers.fingerprint(F.col("edited_anchors")).alias("e"), "near_edited", "near_next").collect()
    return [(r["doc_id"], r["n_chars"], r["sha"], r["f"], r["e"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows]


def test_fingerprints_by_hand(spark):
    rows = syncmers.op13_syncmer_fingerprints(spark, SF).collect()
    texts = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows}
    want = dict(zip([i for i, _ in texts], by_hand([t for _, t in texts]), strict=True))
    assert got == want
    middle = sorted(x[4] for x in want.values())[100]
    assert 0.6 < middle < 0.75 and sum(x[5] for x in want.values()) / 200 < 0.05


def test_fingerprints_of_odd_texts(spark):
    rng = random.Random(6)
    texts = ["", " ", "ab", "one two three four", "one two three four five", "漢字かな交じり文の長い列" * 9, "x" * 5000, "a a a a a a a a a a", "A b C d E f", "a b c d e f", "\U0001f600 " * 40]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = [r[1:] for r in sorted(fingerprinted(df), reverse=True)]
    assert got == by_hand(texts[::-1])
    assert all(0 <= x[4] <= 1 and 0 <= x[5] <= 1 for x in got)


def test_anchors_survive_what_stands_before_them(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    base = " ".join(words)
    moved = " ".join(["quite", "another", "start", "of", "it"] + words)
    other = " ".join(rng.sample(words, 300))
    df = spark.createDataFrame([(base, moved, other)], "a string, b string, c string")
    for c in "abc":
        df = syncmers.with_anchors(df, c, f"{c}_anchors")
    df = syncmers.with_likeness(syncmers.with_likeness(df, "a_anchors", "b_anchors", "moved"), "a_anchors", "c_anchors", "mixed")
    r = df.first()
    assert r["moved"] > 0.95 and r["mixed"] < 0.05
    gaps = [int(x, 16) for x in re.findall(r"(.).{7}", df.select(syncmers.fingerprint(F.col("a_anchors"))).first()[0])]
    assert max(gaps) <= syncmers.K - syncmers.S


def test_fingerprints_odd(spark, odd, empty):
    rows = fingerprinted(odd)
    assert len(rows) == len(ODD) and syncmers.edited(empty).count() == 0
    order = sorted([(i, t or "") for i, t, *_ in ODD if i is not None], key=lambda x: -x[0])
    want = by_hand([t for _, t in order])
    got = {r[0]: r[1:] for r in rows}
    assert all(got[i] == w for (i, _), w, (after, _) in zip(order, want, order[1:]) if after != i)
    one = fingerprinted(spark.createDataFrame([(9, "all alone in the table it is")], "doc_id long, text string"))
    assert one[0][1:] == by_hand(["all alone in the table it is"])[0] and one[0][-1] == 1.0


@pytest.mark.parametrize("ranges", [1, 50])
def test_every_document_has_the_next_one(spark, monkeypatch, ranges):
    monkeypatch.setattr(syncmers, "RANGES_A_PARTITION", ranges)
    ids = random.Random(8).sample(range(-1000, 10**12), 300)
    df = spark.createDataFrame([(i, f"text number {i}") for i in ids], "id long, text string").repartition(7)
    got = {r["id"]: r["next_text"] for r in syncmers.with_next(df).collect()}
    down = sorted(ids, reverse=True)
    assert got == {i: f"text number {n}" for i, n in zip(down, down[1:] + down[:1])}


def test_fingerprints_are_native(spark, docs):
    plan = syncmers.edited(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_new_operators_are_registered():
    assert {"op11_source_divergence", "op12_fill_in_middle", "op13_syncmer_fingerprints"} <= set(queries.QUERIES)
