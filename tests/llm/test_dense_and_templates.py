"""Near-duplicates in large regions, decontamination of copies in other cases, number tables and edited variants, base
rules and further encodings of secrets, and the choice of a language, each against brute force."""

import base64
import collections
import gzip
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from loomtext.llm import decontam, langid, near_dups, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def shingle_sets(texts, width):
    out = {}
    for i, t in texts:
        w = WORD.findall(t.lower())
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}
    return out


def components(texts, width, percent):
    sets = shingle_sets(texts, width)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j]) if i < j else 0
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def template_texts(rng, n, own, words=240):
    """Texts of one template, each with a share of words of its own; some in pairs that are near copies."""
    base = [f"w{i}" for i in range(words)]
    texts = []
    while len(texts) < n:
        w = base[:]
        for k in rng.sample(range(words // 3), int(own * words / 3)):  # apart from each other, so that each breaks its shingles
            w[3 * k] = f"x{rng.random()}"
        texts.append(" ".join(w))
        if rng.random() < 0.3:
            for k in rng.sample(range(words), rng.randint(1, 6)):
                w[k] = f"y{rng.random()}"
            texts.append(" ".join(w))
    return list(enumerate(texts[:n]))


@pytest.mark.parametrize(("own", "block", "meeting"), [(0.1, 16, 2048), (0.1, 16, 8), (0.45, 16, 2048), (0.16, 32, 64)])
def test_large_regions_lose_no_link(spark, monkeypatch, own, block, meeting):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    monkeypatch.setattr(near_dups, "MEETING", meeting)
    monkeypatch.setattr(near_dups, "TURNS", 1)
    texts = template_texts(random.Random(int(100 * own)), 160, own)
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), 3, 85).collect()}
    assert got == components(texts, 3, 85)


@pytest.mark.parametrize("percent", [50, 80, 85, 95, 100])
def test_rare_shingles_meet_in_every_linked_pair(percent):
    rng = random.Random(percent)
    for _ in range(300):
        base = rng.sample(range(1, 10**6), rng.randint(1, 120))
        sets = [np.array(sorted(set(base[: rng.randint(max(1, len(base) // 2), len(base))]) | set(rng.sample(range(1, 10**6), rng.randint(0, 20)))), np.int64) for _ in range(2)]
        some = sorted(set(rng.sample(base, len(base) // 2)))
        known, counts = np.array(some, np.int64), np.array([rng.randint(2, 9) for _ in some], np.int64)
        flat = np.concatenate(sets)
        rows = pa.RecordBatch.from_arrays([pa.array([0, 0]), pa.array([0, 1]), pa.array([0, 1]), pa.array([True, False]), pa.array([len(x) for x in sets]), pa.array([x.tobytes() for x in sets], pa.binary())], ["main", "node", "label", "outside", "n", "shingles"])
        out = next(near_dups.rare_shingles(percent, known, counts)(iter([rows]))).to_pylist()
        seen = [{r["shingle"] for r in out if r["node"] == k} for k in (0, 1)]
        found = [{r["shingle"] for r in out if r["node"] == k and r["index"]} for k in (0, 1)]
        both = len(set(sets[0].tolist()) & set(sets[1].tolist()))
        if both and 100 * both >= percent * (len(flat) - both):
            small = int(len(sets[1]) < len(sets[0]))
            assert found[small] & seen[1 - small]


def test_rows_of_a_dense_region_follow_its_nodes(spark):
    """Half of the nodes outside, alike to about a half: a node more adds no more rows than the one before."""
    rows = []
    for n in (256, 512, 1024):
        texts = template_texts(random.Random(n), n, 0.4)
        sets = shingle_sets(texts, 3)
        made = [(0, i, i % 2 * (i + 1), bool(i % 2), len(s), bytearray(np.sort(np.array([hash(x) for x in s], np.int64)).tobytes())) for i, s in sets.items()]
        big = spark.createDataFrame(made, "main long, node long, label long, outside boolean, n long, shingles binary").repartition(4).cache()
        met = near_dups.meetings(big.drop("shingles"), big.select("node", "shingles"), 85)
        rows.append(near_dups._grid(met, near_dups.F.lit(0), near_dups.MEETING).count())
    assert rows[1] <= 2.2 * rows[0] + 50 and rows[2] <= 2.2 * rows[1] + 50 and rows[2] <= 40 * 1024, rows


# --- decontamination


def judged(spark, texts, items):
    found = decontam.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    return {r["doc_id"]: (r["items"], r["n_exact"], r["n_reparameterised"]) for r in found.collect()}


def test_copies_in_another_case(spark):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    items.append("If Alice buys 12 apples and then sells 7 kg to Bob Smith, how many apples are left over for Carol Jones today")
    for change in (str.lower, str.upper, str.title, str.swapcase):
        got = judged(spark, [f"before it {change(t)} and after it" for t in items], items)
        assert all(k in got[k][0] for k in range(len(items))), change


def test_figures_alone_are_no_evidence(spark):
    rng = random.Random(3)

    def figures(n):
        return " ".join(str(rng.randrange(10**6)) for _ in range(n))

    table = figures(50)
    units = " ".join(f"{rng.randrange(99)} kg" for _ in range(30))
    other_units = " ".join(f"{rng.randrange(99)} kg" for _ in range(30))
    arithmetic = "12 + 15 = 27 and 3 * 4 = 12"
    got = judged(spark, [figures(50), f"so {table} it is", units, other_units, "13 + 16 = 29 and 5 * 6 = 30"], [table, units, arithmetic])
    assert got[0] == ([], 0, 0) and got[1] == ([0], 1, 0) and got[2] == ([1], 1, 0) and got[3] == ([], 0, 0) and got[4] == ([], 0, 0)


def test_tables_of_figures_end_in_seconds(spark):
    rng = random.Random(4)
    numbers = " ".join(str(rng.randrange(100)) for _ in range(5000))
    phrase = " ".join(f"the value of it is {rng.randrange(10**6)} and" for _ in range(700))
    other = " ".join(f"the value of it is {rng.randrange(10**6)} and" for _ in range(700))
    began = time.time()
    got = judged(spark, [numbers, " ".join(str(rng.randrange(100)) for _ in range(5000)), "same " * 5000, phrase, other], [numbers, "same " * 3000, phrase])
    assert time.time() - began < 60
    assert got[0][:2] == ([0], 1) and got[1] == ([], 0, 0) and got[2][:2] == ([1], 1) and 2 in got[3][0] and got[4][1] == 0


def test_variants_with_words_put_in(spark):
    def question(n, k, more=""):
        return f"on one of those days she went out and bought {n} green apples{more} from the old shop by the sea and then sold {k} of them to a man, how many apples are left over for her today"

    texts = [f"{question(30, 9, ' now')} . so on {question(45, 8, ' also')} end", question(30, 9, " now"), f"{question(30, 9)} {question(45, 8)}", question(30, 30), question("thirty", "nine"), question("twelve", "seven")]
    got = judged(spark, texts, [question(12, 7)])
    assert [got[k][2] for k in range(5)] == [1] * 5 and got[5] == ([0], 1, 0)
    # 12 stands for two values, all over the text: no reading.
    item = "she has 12 red pens and he has 12 blue pens so they have many of them in all by now"
    assert judged(spark, [item.replace("12", "5", 1), item.replace("12", "5")], [item]) == {0: ([], 0, 0), 1: ([0], 0, 1)}


def test_an_item_whose_windows_repeat(spark):
    item = " ".join(f"row {c} holds the count {k} for this week only" for k, c in enumerate("abcabcabc", 10))
    other = " ".join(f"row {c} holds the count {k} for this week only" for k, c in enumerate("abcabcabc", 50))
    mixed = " ".join(f"row {c} holds the count {k % 2} for this week only" for k, c in enumerate("abcabcabc"))
    got = judged(spark, [item, other, f"{other} and {other}", "row a holds the count 1 for this week only"], [item])
    assert got[0] == ([0], 1, 0) and got[1] == ([0], 0, 1) and got[2] == ([0], 0, 1) and got[3] == ([], 0, 0)
    assert judged(spark, [mixed], [item])[0][0] in ([], [0])


def test_judging_follows_places():
    """Against a plain search over all diagonals of unique windows."""
    rng = random.Random(5)
    for _ in range(200):
        n, width = rng.randint(3, 12), 4
        windows = [(p, 100 + p, ("",) * 3 + (f"s{p % 3}",)) for p in range(n)]
        found = []
        for start in range(0, 60, n + width + rng.randint(0, 3)):
            value = {f"s{k}": str(rng.randrange(3)) for k in range(3)}
            found += [(start + p, 100 + p, ("",) * 3 + (value[s[-1]] if rng.random() < 0.97 else "odd",)) for p, _, s in windows if rng.random() < 0.9]
        by_start = collections.defaultdict(list)
        for at, h, v in found:
            by_start[at - (h - 100)].append((h - 100, v[-1]))
        want = None
        for pairs in by_start.values():
            reading = {}
            if decontam._covered({p for p, _ in pairs}, width) >= 0.8 * (n + width - 1) and all(reading.setdefault(f"s{p % 3}", v) == v for p, v in pairs):
                want = "reparameterised"
        got, held = decontam.judge(found, windows, n, width)
        assert 0 <= held <= 1 and (got is not None) >= (want is not None)


# --- secrets


def base_spans(text):
    """The three base rules, character by character."""
    out, n = [], len(text)
    word = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    keys = ("password", "passwd", "secret", "token", "api_key", "apikey")
    i = 0
    while i < n:
        end = None
        for key in keys:
            part = text[i : i + len(key)]
            if len(part) == len(key) and part.isascii() and part.lower() == key:
                end = i + len(key)
                break
        value = None
        # Each optional part is tried present first, then absent, as a pattern would.
        for quote in (1, 0) if end is not None else ():
            at = end
            if quote:
                if at >= n or text[at] not in "\"'":
                    continue
                at += 1
            while at < n and text[at] == " ":
                at += 1
            if at >= n or text[at] not in ":=":
                continue
            at += 1
            spaces = at
            while at < n and text[at] == " ":
                at += 1
            del spaces
            if at < n and text[at] in "\"'":
                at += 1
            stop = at
            while stop < n and text[stop] in word:
                stop += 1
            if stop > at:
                value = (at, stop)
                break
        if value:
            if value[1] - value[0] >= 12:
                out.append(("assign", i, value[1]))
            i = value[1]
        else:
            i += 1
    i = 0
    while i < n:
        if text.startswith("AKIA", i):
            stop = i + 4
            while stop < n and (text[stop] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
                stop += 1
            if stop > i + 4:
                if stop - i >= 18:
                    out.append(("access", i, stop))
                i = stop
                continue
        i += 1
    i = 0
    while i < n:
        stop = i
        while stop < n and text[stop] in "0123456789abcdef":
            stop += 1
        if stop - i >= 16:
            out.append(("hex", i, stop))
        i = max(stop, i + 1)
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_rules_character_by_character(spark):
    rng = random.Random(6)
    parts = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "AKIA", "=", ":", " ", "'", '"', "abcdef0123456789", "ABCDEFGHIJKLMNOP", "x", "é", "\n", "hunter2hunter2", "AKIAABCDEFGHIJKLMN"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text in [*made, *texts]:
        assert sorted(secrets.matches(text), key=secrets._order) == base_spans(text), text


def test_glued_data_takes_linear_time():
    took = []
    for n in (40_000, 160_000):
        began = time.time()
        for unit in ("H4sI", "+eJx", "KLUv", "H4sIAAAA"):
            secrets.scan("x " + unit * (n // len(unit)))
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 1, took


def encoded(data):
    return base64.b64encode(data).decode()


@pytest.mark.parametrize(
    "text",
    [
        "".join(f"\\u{{{ord(c):x}}}" for c in "password=hunter2hunter2"),
        "\\u{70}assword=hunter2hunter2",
        "a = '" + "\\n".join(encoded(b"the password=hunter2hunter2 is here")[i : i + 20] for i in range(0, 60, 20)) + "'",
        f"b {encoded('password=hunter2hunter2'.encode('utf-16'))} c",
        f"b {encoded('password=hunter2hunter2'.encode('utf-16-le'))} c",
        f"b {encoded('password=hunter2hunter2'.encode('utf-16-be'))} c",
        f"glued/{encoded(gzip.compress(b'some words and password=hunter2hunter2 in it', mtime=0))}",
        f"glued/{encoded(zlib.compress(b'some words and password=hunter2hunter2 in it'))}",
        f"glued/{encoded(zstandard.compress(b'some words and password=hunter2hunter2 in it'))}",
    ],
)
def test_more_encodings(text):
    base, spans, *_ = secrets.scan(text)
    assert any(k == "assign" for k, _, _ in spans) and all(0 <= s < e <= len(text) for _, s, e in spans)


# --- language


def test_the_choice_is_that_of_the_smallest_encoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = langid.samples(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    made = []
    for name, data in held:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append((name, zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False)))
    found = {r["doc_id"]: r for r in langid.op1_language_id(spark, SF).collect()}
    for r in docs.select("doc_id", "text").collect():
        letters = " ".join(re.findall(r"[^\W\d_]+", r["text"] or "", re.U)).lower().encode()
        data = langid.normal(r["text"])
        assert data.replace(b" ", b"") == letters.replace(b" ", b"") or not data.isascii()
        sizes = [(sum(len(c.compress(data[i : i + langid.PIECE])) for i in range(0, len(data), langid.PIECE)), k) for k, (_, c) in enumerate(made)]
        best, second = sorted(sizes)[:2]
        got = found[r["doc_id"]]
        assert got["lang_pred"] == made[best[1]][0] if data else got["lang_pred"] == "und"
        assert got["sure"] == (bool(data) and second[0] - best[0] >= langid.MARGIN * second[0])
