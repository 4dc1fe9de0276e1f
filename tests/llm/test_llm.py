"""The ten operators and the pipeline against brute force, SQL and held-out labels; and their odd cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import _text, bpe, decontam, jaccard, langid, lines, packing, quality, queries, rans, rules, secrets, tokens, urls
from tessera.llm._stage import Workspace
from tests.oracle import SMALL, duck, rows_of_duck, rows_of_spark

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "one", "en", None, 3), (5, "x " * 60_000, "en", "s", 120_000),
    (6, "same words in both of these rows, twice over\nand a line", "en", "s", 50), (6, "same words in both of these rows, twice over\nand a line", "en", "s", 50),
    (7, "same words in both of these rows, twice over\nand a line", "de", "t", 50), (None, "a row without an id has text too", "en", "s", 33), (8, "日本語 の テキスト です é ü", None, "t", 15), (9, "12345 67890 !!!", "en", "s", 15),
]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(small):
    return {r.doc_id: r.text for r in small.select("doc_id", "text").collect()}


def odd(spark):
    """Odd rows with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit("mine") for c in ("_words", "text_hash", "node", "host", "row", "_score", "_kept", "_id", "n", "kept", "_url", "shard")})


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert rows_of_spark(queries.queries()[name](spark, SMALL)) == rows_of_duck(duck(), queries.oracle_sql()[name])


def test_text_hashes_tell_words_apart():
    column = pa.array(["a b  a\n", None, "", "b\ta", " "])
    for _, data, starts in _text.pieces(column):
        rows, a, b = _text.spans(~_text.SPACE[data], starts)
        h = _text.span_hashes(data, a, b, {})
    assert rows.tolist() == [0, 0, 0, 3, 3] and h[0] == h[2] == h[4] != h[1] == h[3]


def test_pieces_are_bounded_in_rows_too():
    column = pa.array(["a b"] * 10_000)
    got = [(row, len(starts) - 1) for row, _, starts in _text.pieces(column)]
    assert sum(n for _, n in got) == 10_000 and max(n for _, n in got) == 4096 and [row for row, _ in got] == [0, 4096, 8192]


def test_a_long_row_is_hashed_in_parts():
    text = " ".join(f"w{i % 977}" for i in range(3000)) + " " + "y" * 500 + "  z"
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.array([0, len(data)])
    for most in (1, 7, 64, 1000):
        rows, words = _text.word_hashes(data, starts, {}, most)
        assert (words == _text.word_hashes(data, starts, {})[1]).all() and not rows.any() and len(words) == 3002


# 1


def test_lines(spark):
    rows = [(i, f"head of site\nline {i}\n head of site \nrare", "en", "a" if i < 20 else None, 1) for i in range(40)]
    out = {r.doc_id: r for r in lines.drop_lines(spark.createDataFrame(rows, DOCS), ratio=0.5, pages=5).collect()}
    assert out[3].text == "line 3" and out[3]._n_dropped == 3 and out[30].text == "line 30"


def test_lines_odd(spark):
    out = lines.drop_lines(odd(spark), ratio=0.1, pages=2)
    got = {(r.doc_id, r.source): (r.text, r._n_dropped, r.kept) for r in out.collect()}
    assert out.count() == len(ODD) and got[1, None][0] is None and got[6, "s"][1] == 2 and got[6, "s"][0] == "" and got[7, "t"][1] == 0 and got[7, "t"][2] == "mine"
    assert lines.drop_lines(spark.createDataFrame([], DOCS)).count() == 0


# 2


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.queries()["op2_quality_mil"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9


def test_quality_odd(spark):
    model = quality.train([], np.zeros(0, np.float32))
    out = quality.classify(odd(spark), model).collect()
    assert len(out) == len(ODD) and all(0 <= r._score <= 1 and r.row == "mine" for r in out)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(spark.createDataFrame([], DOCS), labels)["c0"][0] == 0


def test_quality_trains_on_every_passage(spark):
    text = " ".join(f"w{i}" for i in range(100 * quality.PASSAGE - 1))
    docs = spark.createDataFrame([(i, text) for i in range(1, 4)], "doc_id long, text string")
    bags, _ = quality.sample(docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    for _, data, starts in _text.pieces(pa.array([text])):
        x, _ = quality.encode(data, starts, {})
    assert bags and len(x) == 100 and all((b == x.astype(np.float16)).all() for b in bags)


def test_quality_learns_from_bags():
    rng = np.random.default_rng(0)
    bags = [rng.standard_normal((rng.integers(1, 6), quality.WIDTH)).astype(np.float32) * 0.1 for _ in range(300)]
    y = rng.integers(0, 2, 300).astype(np.float32)
    for bag, label in zip(bags, y, strict=True):
        bag[rng.integers(len(bag)), 0] += 4 * label
    m = quality.train(bags, y)
    s = [quality.score(b, np.zeros(len(b), np.int64), 1, m)[0] for b in bags]
    assert np.mean((np.array(s) > 0.5) == (y > 0.5)) > 0.95


# 3


@pytest.mark.parametrize("n", [1, 2, 63, 64, 5000, 300_000])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint32)
    table = rans.Table(*np.unique(ids, return_counts=True))
    assert int(table.freq.sum()) == 1 << rans.SCALE
    sizes = np.array([n // 2, n - n // 2])
    raw = rans.pack(ids, np.array([5, 0]), np.array([False, True]), sizes, table)
    block = rans.Block(raw)
    slots = table.slots()
    assert (block.ids(table, slots) == ids).all() and block.sizes.tolist() == sizes.tolist() and block.nulls.tolist() == [False, True]
    # Any checkpoint can be decoded on its own.
    k = len(block.points) - 1
    at = k * rans.EVERY * block.lanes
    assert (block.part(k, table, slots)[: n - at] == ids[at:]).all()
    for bad in (0, len(raw) // 2, len(raw) - 1):
        with pytest.raises(rans.Damaged):
            rans.Block(raw[:bad] + bytes([raw[bad] ^ 1]) + raw[bad + 1 :])


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids + [tokens.END] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_tokens_of_a_table(spark, texts):
    found = queries.queries()["op3_token_rans"](spark, SMALL).orderBy("doc_id").collect()
    start = 0
    for r, ids in zip(found, reference_ids([texts[k] for k in sorted(texts)]), strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_tokens_odd(spark, tmp_path):
    import public_tokenizers

    space = Workspace(spark, "odd")
    tokens.write(odd(spark), public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path), space)
    out = tokens.read(spark, str(tmp_path)).orderBy("start").collect()
    assert len(out) == len(ODD) and out[0].doc_id is None and out[1].n_tokens == out[2].n_tokens == 1
    tokens.write(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "none"), space)
    assert tokens.read(spark, str(tmp_path / "none")).count() == 0


def test_pieces_encode_like_whole_texts():
    import public_tokenizers

    rng = random.Random(1)
    parts = ["a", "The", "é", "ß", "12", "'s", "'", "...", "!", " ", "  ", "\n", "\t", "\r\n", "　", " ", "日本", "<|endoftext|>", "\x1c", "-", "we're", "🙂"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(400)] + [None, ""]
    got = []
    for _, ids, at in bpe.encode_column(pa.array(texts, pa.string()), public_tokenizers.path("byte_bpe_50k.json"), tokens.END, {}):
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(len(at) - 1)]
    assert got == reference_ids(texts)


# 4


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    five = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, hit = collections.Counter(five), set()
    for i, g in enumerate(five):
        if often[g] > 1:
            hit.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_rules_base(spark, small, texts):
    out = rules.judge(small.unionByName(spark.createDataFrame([(k + 10**6 if k else None, *x) for k, *x in ODD], DOCS)), np.zeros(1 << rules.BITS), 0.0).collect()
    given = dict(texts) | {k + 10**6: t for k, t, *_ in ODD if k}
    for r in out:
        if r.doc_id is not None:
            base = plain_base(given[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
            assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0]) and r.kept == (not r.base_failed)


def test_rules_ratio(spark):
    good, bad = "alpha beta gamma delta " * 30, "buy $$$ now !!! " * 30
    docs = spark.createDataFrame([(i, good if i % 2 else bad, i % 2 == 1) for i in range(40)], "doc_id long, text string, trusted boolean")
    llr = rules.ratios(docs, prior=100)
    plain = collections.Counter()
    for _, data, starts in _text.pieces(pa.array([good, bad])):
        h, r = rules.buckets(*rules._words(data, starts, {})[:2])
        plain.update(zip(r.tolist(), h.tolist(), strict=True))
    assert sum(plain.values()) * 20 == sum(x.raw for x in rules.counts(docs).collect())
    score = {r.doc_id: r.score for r in rules.judge(docs, llr, 0.0).collect()}
    assert score[1] > 0 > score[0]
    assert (rules.ratios(docs.limit(0)) == 0).all()


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_rules_trust_every_good_document(spark, monkeypatch, broadcast):
    monkeypatch.setattr(rules, "BROADCAST_ROWS", broadcast, raising=False)
    ids = spark.range(30_000).select(F.col("id").alias("doc_id"))
    labels = ids.select("doc_id", (F.col("doc_id") % 6 != 0).cast("int").alias("quality"))
    out = rules.trusted_rows(ids.withColumn("text", F.lit("one two")), labels.union(labels))
    assert out.count() == 30_000 and out.filter("trusted").count() == 25_000 and out.filter("trusted and doc_id % 6 = 0").count() == 0


# 5


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://Example.COM/en/70?x", "example.com", "/en/70", "example.com/en/7"), ("https://a.b.com/en/x#f", "a.b.com", "/en/x", "com/en/"), ("https://xexample.net/de/8", "xexample.net", "/de/8", "net/de/"),
        ("ftp://m.example.net/de/8/9", "m.example.net", "/de/8/9", "example.net/de/8"), ("//example.com/en/", "", "", None), (None, "", "", None), ("", "", "", None), ("a://b://c/d", "b:", "//c/d", None), ("http://?q", "", "", None),
    ],
)
def test_url_parts(spark, url, host, path, rule):
    pages = spark.createDataFrame([(1, url, "mine", "mine")], "page_id long, url string, host string, _maybe string")
    r = urls.judge(pages, spark.createDataFrame([], "_url string")).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)


def test_bloom_never_misses_and_the_join_is_exact(spark, monkeypatch):
    listed = spark.range(2000).select(F.concat(F.lit("h/"), F.col("id") * 3).alias("_url"))
    pages = spark.range(6000).select("id", F.concat(F.lit("h/"), "id").alias("_url")).union(spark.sql("select 9999L, cast(null as string)"))
    for most in (1 << 30, 0):  # broadcast, and joined by block
        monkeypatch.setattr(urls, "BROADCAST_BYTES", most)
        out = urls.on_list(pages, listed).collect()
        assert len(out) == 6001 and all(r._listed == (r.id % 3 == 0 and r.id < 6000) for r in out)
        assert all(r._maybe for r in out if r._listed) and sum(r._maybe for r in out) < 2000 + 0.02 * 4000


# 6


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = queries.queries()["op6_language_id"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_language_odd(spark):
    model = langid.fit(odd(spark))
    out = {r.doc_id: r for r in langid.predict(odd(spark), model).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3, 9)] == ["und"] * 4 and out[8].lang_pred in ("en", "de") and out[1].score == 0
    none = spark.createDataFrame([], DOCS)
    assert langid.predict(none, langid.fit(none)).count() == 0


# 7


def test_secrets(spark):
    key = "kJ8s0dPq2LmZx7Vt4RbW1nYc"
    rows = [
        (1, f'x password = "{key}" and TOKEN:short1 and api_key: "abcdefgh"'), (2, "AKIA1234567890ABCD and AKIA12"), (3, "é " + "0123456789abcdef" * 2 + " end"), (4, None), (5, ""),
        (6, f"Authorization uses bearer {key}{key[::-1]} here"), (7, "the token documentation_documentation_documentation is plain"), (8, "ſecret=12345678"),
    ]
    out = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1].n_assign, out[2].n_access, out[3].n_hex) == (2, 1, 1)
    assert out[3].spans == "hex:2:34" and out[3].base_sha256 == hashlib.sha256(b"hex:2:34").hexdigest()
    assert out[4].base_sha256 == out[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[6].n_novel == 1 and "novel:26:74" in out[6].spans and out[7].n_novel == 0 and out[8].n_assign == 0


def test_secrets_behind_decoys_and_line_breaks(spark):
    key = "kJ8s0dPq2LmZx7Vt4RbW1nYc"
    texts = [f"token production-database-url value {key}", f'"secret":\n  "{key}"', f"credential {'word ' * 30}{key} and {key[::-1]}", f"token {'word ' * 100}{key}"]
    out = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, t in zip(out[:3], texts, strict=False):
        assert {f"novel:{t.index(k)}:{t.index(k) + len(k)}" for k in (key, key[::-1]) if k in t} <= set(r.spans.split(","))
    assert out[3].spans == ""


def test_secret_base_is_the_plain_patterns(texts):
    for t in list(texts.values())[:200]:
        plain = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 8]
        plain += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert secrets.base_spans(t) == sorted(plain)


# 8

DWORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(docs, items):
    words = lambda t: DWORD.findall((t or "").translate(LOW))
    windows = collections.defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1):
            if n:
                windows[tuple(w[i : i + n])].add(k)
    for t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[g]
        yield len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_decontamination(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", broadcast)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, say(n)) for k, n in enumerate([14, 30, 12, 10, 11, 1, 3, 5, 7, 9])] + [(90, None), (91, ""), (92, "!!")]
    items += [(93, items[0][1]), (10, items[1][1])]
    docs = [(k, say(rng.randint(0, 60)) + " " + ("" if k % 3 else " ".join(items[k % 5][1].split()[2:13]).upper()) + ". " + say(5)) for k in range(40)]
    docs += [(1000, None), (1001, ""), (1002, items[5][1]), (None, items[1][1]), (6, docs[6][1])]
    out = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("_text", F.lit("mine")), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in out.collect()), key=str)
    assert got == sorted(((k, *x) for (k, _), x in zip(docs, plain_hits([t for _, t in docs], items), strict=True)), key=str)


def test_decontamination_without_items(spark):
    out = decontam.contaminated(odd(spark), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(out) == len(ODD) and not any(r.contaminated for r in out)
    assert decontam.contaminated(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# 9


def check_packing(docs, out, capacity):
    """Every word once, no bin too full, no two pieces of one source or of equal texts in a bin."""
    length = collections.Counter((d.doc_id, len(WORD.findall(d.text or "")) + 1) for d in docs)
    total = collections.defaultdict(int)
    for r in out:
        total[r.doc_id] += r.length
    assert sum(n * k for (_, n), k in length.items()) == sum(total.values())
    used, bins = collections.Counter(), collections.defaultdict(list)
    for r in out:
        used[r.bin_id] += r.length
        bins[r.bin_id].append(r)
    source = {d.doc_id: d.source for d in docs}
    text = {d.doc_id: tuple(WORD.findall((d.text or "").lower())) for d in docs}
    for b, rows in bins.items():
        assert used[b] <= capacity
        spans = sorted((r.bin_offset, r.bin_offset + r.length) for r in rows)
        assert all(x[1] == y[0] for x, y in itertools.pairwise(spans)) and spans[0][0] == 0
        assert len({source[r.doc_id] for r in rows}) == len({text[r.doc_id] for r in rows}) == len(rows)
    return len(bins)


def test_packing(spark, small):
    docs = small.collect()
    out = packing.pack(small, capacity=512, shard=70).collect()
    n = check_packing(docs, out, 512)
    hot = max(collections.Counter(d.source for d in docs).values())
    total = sum(r.length for r in out)
    assert n >= max(total / 512, hot) and n < 1.7 * max(total / 512, hot) + 20


@pytest.mark.parametrize(("sources", "clusters"), [(7, 256), (900, 5000), (1, 1)])
def test_best_fit_is_the_tightest_compatible_bin(sources, clusters):
    rng, bins, plain = random.Random(2), packing.Bins(100, sources, clusters), []
    for _ in range(1500):
        size, s, k = rng.randint(1, 100), rng.randrange(sources), rng.randrange(clusters)
        fits = [b for b in plain if b[0] >= size and s not in b[1] and k not in b[2]]
        got, offset = bins.place(size, s, k)
        if fits:
            assert plain[got][0] == min(b[0] for b in fits) and offset == 100 - plain[got][0]
        else:
            assert got == len(plain) and offset == 0
            plain.append([100, set(), set()])
        plain[got][0] -= size
        plain[got][1].add(s)
        plain[got][2].add(k)


def test_only_what_repeats_has_a_bit():
    assert packing.numbered(np.array([5, 7, 5, -3, 9, -3], np.int64)) == ([1, -1, 1, 0, -1, 0], 2) and packing.numbered(np.zeros(0, np.int64)) == ([], 0)
    bins = packing.Bins(10, 1, 1)
    assert [bins.place(4, -1, -1), bins.place(4, 0, -1), bins.place(1, 0, 0), bins.place(1, -1, 0), bins.place(2, -1, -1)] == [(0, 0), (0, 4), (1, 0), (0, 8), (1, 1)]


def test_packing_odd(spark):
    out = packing.pack(odd(spark), capacity=1000).collect()
    assert sum(r.length for r in out) == sum(len(WORD.findall(t or "")) + 1 for _, t, *_ in ODD)
    assert sum(r.doc_id == 5 for r in out) == 61 and packing.pack(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_packing_keeps_near_copies_apart(spark, monkeypatch, tmp_path, broadcast):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"other{k}"] + base[k + 1 :]) for k in (0, 59)] + [" ".join(base), " ".join(base).upper()]
    rows = [(i, texts[i % 4], "en", f"s{i}", 1) for i in range(8)] + [(8 + i, " ".join(f"x{i}y{j}" for j in range(20)), "en", f"t{i}", 1) for i in range(8)]
    rows += [(16, None, "en", "u", 0), (17, "", "en", "v", 0), (None, texts[0], "en", "w", 1), (None, texts[1], "en", "x", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = packing.op9_best_fit(spark, str(tmp_path)).collect()
    near = {0, 1, 2, 3, 4, 5, 6, 7, None}
    held = [r.bin_id for r in out if r.doc_id in near]
    assert len(out) == len(rows) and len(held) == len(set(held)) == 10
    assert len({r.bin_id for r in out if r.doc_id in (16, 17)}) == 2


# 10


def plain_classes(rows):
    sets, parent = {}, {}
    for k, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
        parent[k] = k

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: (len(s), find(k)) for k, s in sets.items()}


def near_copies(n=160, seed=4):
    """Chains and clusters of edited copies, some under and some over the threshold, and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    bases = [rng.choices(vocabulary, k=rng.choice([6, 20, 60, 150])) for _ in range(12)]
    rows = []
    for k in range(n):
        w = list(bases[k % 4 if k % 2 else k % 12])
        for _ in range(rng.randint(0, max(1, len(w) // 40))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((k, " ".join(w).upper() if k % 5 == 0 else "  ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "a b"), (n + 3, "A  b"), (n + 4, "a b c"), (n + 5, "b")]


@pytest.mark.parametrize("times", [4, 0])
def test_near_duplicates(spark, monkeypatch, times):
    monkeypatch.setattr(jaccard, "TIMES", times)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 10 * times)
    monkeypatch.setattr(jaccard, "SPARE", 100_000 * times)
    monkeypatch.setattr(jaccard, "GROUP", 8 * times + 2)
    rows = near_copies()
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("mine")))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == plain_classes(rows)


@pytest.mark.parametrize("head,group", [(32, 32), (1000, 2), (3, 2)])
def test_all_links(spark, monkeypatch, head, group):
    monkeypatch.setattr(jaccard, "HEAD", head)
    monkeypatch.setattr(jaccard, "GROUP", group)
    rows = near_copies(80)
    join = jaccard.Join(spark.createDataFrame(rows, "doc_id long, text string"))
    if head == 1000:
        met = join.between(join.shared)
        assert met.count() == met.distinct().count() > 0
    doc = {r.node: r.doc for r in join.nodes.collect()}
    got = {tuple(sorted((doc[r.a], doc[r.b]))) for r in join.all_links().collect()}
    sets = {}
    for k, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        s = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])
        if s and s not in sets.values():
            sets[k] = s
    assert got == {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("block", [512, 7])
def test_every_link_counts(spark, monkeypatch, block):
    """Also between texts of one class whose links were not needed to find it, and between copies."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "WIDTH", 50 * block)
    monkeypatch.setattr(jaccard, "GROUP", 4)
    words = [f"w{i}" for i in range(120)]
    rows = near_copies(60) + [(100 + k, " ".join(words[: 2 * k] + [f"x{k}"] + words[2 * k + 1 :])) for k in range(60)]
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = collections.Counter()
    sets = {}
    for k, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            want.update((a, b))
    assert {r.doc_id: r.n_links for r in out.collect()} == {k: want[k] for k in sets}


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_components(spark, monkeypatch, most):
    """A long chain, stars, copies of a link, both directions, and no link at all; few links cost the driver few jobs."""
    monkeypatch.setattr(jaccard, "LINKS", most)
    rng = random.Random(5)
    ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(120)]
    links = [(ids[k], ids[k + 1]) for k in range(39)] + [(ids[40], x) for x in ids[41:60]] + [(ids[61], ids[60])] * 2 + [(ids[60], ids[61])] + [(rng.choice(ids[62:]), rng.choice(ids[62:])) for _ in range(40)]
    links = [x for x in links if x[0] != x[1]]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    space = Workspace(spark, "components")
    made = space.keep("links", spark.createDataFrame(links, "a long, b long"))
    spark.sparkContext.setJobGroup(f"components {most}", "")
    try:
        got = jaccard.components(made, space, "roots")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r.node, r.root) for r in got.collect()) == sorted((x, find(x)) for x in parent)
    if most:
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {most}")) <= 4
    assert jaccard.components(made.limit(0), space, "none").count() == 0


def test_near_duplicates_odd(spark):
    out = jaccard.near_duplicates(odd(spark)).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r.component_id)
    assert len(out) == len(ODD) and by[6] == [6, 6] and by[7] == [6] and by[2] == [2] and by[1] == [1] and by[None] == [None]
    assert jaccard.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


# The pipeline


def test_stages(spark, small):
    """Each stage against a plain version, on what the one before has kept."""
    docs, seen = small.select(*corpus_pipeline.COLUMNS), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = Workspace(spark, "stages").keep(name, stage(spark, docs, SMALL))
        rows, was = docs.collect(), before.collect()
        seen[name] = len(rows)
        if name != "best_fit_packing":
            assert docs.columns == small.columns
        if name == "line_dedup":
            assert {r.doc_id for r in rows} == {r.doc_id for r in was} and all(r.n_chars == len(r.text) for r in rows)
        if name == "near_duplicates":
            want = plain_classes([(r.doc_id, r.text) for r in was])
            assert {r.doc_id for r in rows} == {k for k, (_, c) in want.items() if k == c}
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            hits = list(plain_hits([r.text for r in was], items))
            assert {r.doc_id for r in rows} == {r.doc_id for r, h in zip(was, hits, strict=True) if not h[1]}
        if name == "best_fit_packing":
            check_packing(was, rows, packing.CAPACITY)
    assert seen["quality_classifier"] < small.count()


def test_repeated_rows_leave_one(spark):
    rows = [(1, "one two three four five six seven", "en", "a", 1)] * 3 + [(2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "eins zwei drei vier fünf sechs", "de", None, 3)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), SMALL)
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, rows[-1][1]), (1, rows[0][1]), (2, ""), (2, "")]


def test_near_copies_of_one_id_leave_one(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in (0, 30, 59)] + [" ".join(words)]
    other = [" ".join(f"{c}{i}" for i in range(20)) for c in "yz"]
    rows = [(i, t, "en", "a", 1) for i in (3, None) for t in (texts if i else [x.replace("w", "v") for x in texts])] + [(3, other[0], "en", "a", 1), (None, other[1], "en", "a", 1), (3, texts[0], "en", "b", 1)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), SMALL).collect()
    assert len(out) == 4 and {r.text for r in out} >= set(other)
    assert sum("w20 " in r.text for r in out) == sum("v20 " in r.text for r in out) == 1


def test_a_poor_label_set_rejects_nothing_at_random(spark):
    rows = [(i, "plain words that mean little but are fine here", "en", "a", 5) for i in range(10)]
    kept = corpus_pipeline.quality_classifier(spark, spark.createDataFrame(rows, DOCS), SMALL)
    assert kept.count() in (0, 10)
