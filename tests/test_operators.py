"""Small cases of single operators, and differential tests against plain Python."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import dedup, extract, models, relational, search, similar, times
from tessera.plans import fixtures as X
from tessera.plans import registry
from tessera.sources import files
from tessera.streaming import stateful
from tests.oracle import duck, rows_of_duck, rows_of_spark


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_wildcards_are_escaped(spark):
    df = spark.createDataFrame([("foo_bar",), ("fooXbar",)], ["t"])
    assert [r.t for r in df.filter(T.contains(F.col("t"), "foo_bar")).collect()] == ["foo_bar"]
    assert df.filter(T.wildcard(F.col("t"), "foo_bar")).count() == 2


def test_whole_word_in_any_script(spark):
    assert not one(spark, T.whole_word(F.col("t"), "caf"), t="café")
    assert one(spark, T.whole_word(F.col("t"), "ai"), t="we use ai, daily")
    assert not one(spark, T.whole_word(F.col("t"), "ai"), t="email")


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 1001, 1800, 1801, 5000])
def test_windows(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    expected, i = [], 0
    while i < n:
        expected.append(text[i : i + 1000])
        if i + 1000 >= n:
            break
        i += 800
    assert one(spark, T.windows(F.col("t")), t=text) == expected


def test_snippet(spark):
    text = "a" * 100 + "needle" + "b" * 100
    assert one(spark, T.snippet(F.col("t"), "NEEDLE"), t=text) == "..." + "a" * 60 + "needle" + "b" * 60 + "..."
    assert one(spark, T.snippet(F.col("t"), "zzz"), t=text) == text[:120]


def test_context_needs_no_equal_turns(spark):
    df = spark.createDataFrame([(1, i, str(i)) for i in range(5)], ["g", "o", "v"])
    row = relational.around(df, "g", "o", F.col("v"), 2).filter("o = 2").first()
    assert (row._before, row._after) == (["0", "1"], ["3", "4"])


def test_overlap_join_gives_each_pair_once(spark):
    rows = [(i, i * 50, i * 50 + 400) for i in range(40)]
    a = spark.createDataFrame(rows, ["i", "s", "e"])
    b = a.toDF("j", "s2", "e2")
    got = relational.overlap_join(a, b, ("s", "e"), ("s2", "e2"), 100).filter("i < j")
    expected = sum(x[1] < y[2] and y[1] < x[2] for x in rows for y in rows if x[0] < y[0])
    assert got.count() == got.distinct().count() == expected


def test_news_are_ranked_before_sports_and_hubs(spark):
    rows = spark.sql(X.WEB).withColumn("s", search.web_score("latest news sweden", F.lit(X.NOW).cast("timestamp"))).orderBy(F.desc("s"))
    order = [r.id for r in rows.collect()]
    assert order[0] == 1 and order.index(2) > order.index(3) and order[-1] in (4, 6)


def test_unreadable_age_scores_nothing_and_future_age_scores_one(spark):
    now = F.lit(X.NOW).cast("timestamp")
    score = lambda a: one(spark, search.recency(F.col("a"), now), a=a)
    assert (score("soon"), score("2025-01-01"), score("2024-01-16"), score("2023-12-01")) == (0.0, 1.0, 15 / 23, 0.0)


def like_sql(spark, folder, name, **tables):
    """The rows of a query over small tables of its own, after they have been compared with those of its SQL."""
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
    got = rows_of_spark(registry.queries()[name](spark, str(folder)))
    assert got == rows_of_duck(duck(folder), registry.oracle_sql()[name])
    return got[1]


def test_recency_counts_whole_days(spark, tmp_path):
    times = ["2024-01-11 00:00:00.636583", "2024-01-11 00:00:00", "2024-01-10 23:59:59.999999", "2024-01-24 00:00:00.000001", "2024-01-23 00:00:00.5", "2024-01-23", "2024-01-01 00:00:00.1", "2024-01-01", "2024-02-01 00:00:00.1", "1901-01-01", None]
    df = spark.createDataFrame(list(enumerate(times)), "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = dict(like_sql(spark, tmp_path, "f5_recency", events=df))
    assert got["0"] == f"{11 / 23:.8g}" and got["1"] == f"{10 / 23:.8g}" and got["10"] is None


def test_page_title_as_written(spark, tmp_path):
    titles = ["a&amp;b &quot;c&quot; &lt;d&gt;", "cut &am", "cut &amp", "&amp;amp;", "\u00a0\u3000 x\t\n y\u000b \u2003", "two</title><title>more", "", "a\\b $1 <b>c</b>", "line\r\n\r\nline"]
    pages = [f"<html><head><title>{x}</title></head></html>" for x in titles] + ["<TITLE>upper</TITLE>", "<title lang='en'>x</title>", "<title>open", "no title", "", None]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = dict(like_sql(spark, tmp_path, "x2_page_title", pages=df))
    assert got["0"] == "a&b &quot;c&quot; &lt;d&gt;" and got["3"] == "&amp;" and got["4"] == "x y\u000b"


def test_similar_is_exact(spark):
    import random

    rng = random.Random(3)
    sets = [sorted(rng.sample("abcdefghij", rng.randint(1, 8))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(sets)), ["k", "w"])
    got = {(r.a, r.b) for r in dedup.similar(df, "k", F.col("w"), 0.6).collect()}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(set(sets[i]) & set(sets[j])) >= 0.6 * len(set(sets[i]) | set(sets[j]))}
    assert got == want


@pytest.mark.parametrize("sketches", [1 << 27, 0])
def test_similar_with_copies(spark, monkeypatch, sketches):
    """Repeated words, copies, near copies and words of all counts, in short runs and steps."""
    for name, value in {"SKETCHES": sketches, "CHUNK": 500, "HELD": 300, "STEP": 50, "HEAD": 2}.items():
        monkeypatch.setattr(similar, name, value)
    rng = random.Random(5)
    bases = [rng.sample(range(400), n) for n in (5, 20, 60, 150)]
    rows = [(k, [w if rng.random() > 0.08 else rng.randrange(800) for w in bases[k % 4]]) for k in range(100)]
    rows += [(k + 100, rows[k][1] * 2) for k in range(0, 40, 3)] + [(200, []), (None, rows[0][1]), (201, None)]
    df = spark.createDataFrame(rows, "k long, w array<long>").withColumn("g", F.col("k") % 2)
    sets = {k: set(w) for k, w in rows if k is not None and w}
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    want = {k: v for k, v in want.items() if v >= 0.6}
    for same in ([], ["g"]):
        got = [((r.a, r.b), r.similarity) for r in dedup.similar(df, "k", F.col("w").cast("array<string>"), 0.6, same).collect()]
        assert len(got) == len(dict(got)) and dict(got) == {k: v for k, v in want.items() if not same or (k[0] - k[1]) % 2 == 0}


@pytest.mark.parametrize("block", [1, 5, 8192])
def test_nearest_of_each(spark, block):
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(30)]
    rows = [(k, [x / sum(y * y for y in v) ** 0.5 for x in v]) for k, v in enumerate(vectors)] + [(30, None), (None, [1.0, 0.0, 0.0, 0.0])]
    rows += [rows[3], (31, rows[4][1])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: r.similarity for r in search.nearest_of_each(df, df.filter("id % 3 = 1 or id = 3"), "id", "v", block).collect()}
    full = [(k, v) for k, v in rows if k is not None and v is not None]
    want = {k: max(sum(x * y for x, y in zip(v, w, strict=True)) for j, w in full if j != k) for k, v in full if k % 3 == 1 or k == 3}
    assert got == pytest.approx(want)
    assert search.nearest_of_each(df.filter("false"), df, "id", "v", block).count() == 0
    assert search.nearest_of_each(df, df.filter("false"), "id", "v", block).count() == 0


def test_components(spark):
    v = spark.range(12).withColumnRenamed("id", "n")
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 6)] + [(8, 9), (10, 9)], ["a", "b"])
    assert {r.n: r.component for r in dedup.components(v, e, "n").collect()} == {**dict.fromkeys(range(7), 0), 7: 7, 8: 8, 9: 8, 10: 8, 11: 11}


def test_sentence_chunks():
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(80)) + " " + "x" * 2500
    chunks = extract.sentence_chunks(text)
    assert all(len(c) <= 1000 for c in chunks) and chunks[0].startswith("Sentence number 0")
    assert set(re.findall(r"number (\d+) ", " ".join(chunks))) == {str(i) for i in range(80)}
    assert extract.sentence_chunks("") == [] and extract.sentence_chunks(None) == []


def test_page():
    html = "<html><head><title>A &amp; b</title><meta name='Description' content='d'><meta property='og:image' content='/rel.png'><meta name='twitter:image' content='https://x/y.png'><script src='/react.js'></script></head><body><nav>menu</nav><div class='entry'>short</div><ul><li>one</li><li>two <b>x</b></li></ul><table><tr><td>1</td><th>2</th></tr></table><pre>code</pre></body></html>"
    p = extract.page(html)
    assert (p["title"], p["description"], p["image"], p["rendered"]) == ("A & b", "d", "https://x/y.png", True)
    assert p["lists"] == [["one", "two x"]] and p["tables"] == [[["1", "2"]]] and p["code"] == ["code"]
    assert "menu" not in p["content"] and "short" in p["content"]
    assert extract.page("")["content"] == ""


def test_thread():
    turns = extract.thread_turns("Thanks!\n\nOn Monday Ann wrote:\n> Hello\n> > Older\n")
    assert [(lv, text) for lv, _, text in turns if text] == [(0, "Thanks!"), (1, "Hello"), (2, "Older")]
    assert extract.thread_turns(None) == []


def test_recurrence_matches_dateutil():
    rrule = pytest.importorskip("dateutil.rrule")
    start = datetime(2024, 1, 31, 8)
    for rule in ("FREQ=DAILY;COUNT=5", "FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,WE,FR;COUNT=9", "FREQ=MONTHLY;COUNT=5", "FREQ=DAILY;INTERVAL=3;UNTIL=20240301T080000", "FREQ=YEARLY;COUNT=3"):
        assert list(extract.occurrences(start, rule)) == list(rrule.rrulestr(rule, dtstart=start))


def test_recurrence_cap_and_bad_rule():
    a, b = datetime(2020, 1, 1), datetime(2030, 1, 1)
    found = extract.expand("u", datetime(2020, 1, 1, 9), datetime(2020, 1, 1, 10), "FREQ=DAILY", a, b)
    assert len(found) == 1000 and all(x[3] for x in found)
    assert len(extract.expand("u", datetime(2020, 1, 1, 9), datetime(2020, 1, 1, 10), "FREQ=NEVER", a, b)) == 1


def test_limiter_forgets_denied_calls():
    assert stateful.admit([0, 1, 2, 3, 10, 11], 2, 10) == [True, True, False, False, True, True]


def test_every_nth_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i % 2, i) for i in range(20)], "user int, i int")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("user int, i int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.every_nth_stream(source, "user", 3).writeStream.format("memory").queryName("nth").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.user: r.n for r in spark.sql("select user, sum(fired) n from nth group by user").collect()} == {0: 3, 1: 3}


def test_counters_stream(spark, tmp_path):
    spark.createDataFrame([("a", 60.0), ("a", 10.0), ("b", 70.0)], "k string, v double").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k string, v double").parquet(str(tmp_path / "in"))
    q = stateful.counters_stream(source, "k", F.col("v") > 50).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.total, r.hits) for r in spark.table("counts").collect()} == {("a", 2, 1), ("b", 1, 1)}


def test_first_batch_is_the_baseline(spark):
    batch = spark.range(60).withColumnRenamed("id", "k")
    assert stateful.unseen(batch, None, "k", "k").count() == 0
    assert stateful.unseen(spark.range(120).withColumnRenamed("id", "k"), batch, "k", "k").count() == 50


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"text": "x"}]')
    (tmp_path / "b.json").write_text("line")
    (tmp_path / "c.md").write_text("words " * 400)
    texts = files.whole_texts(spark, f"{tmp_path}/*.json")
    assert {r.path.rsplit("/", 1)[1] for r in files.broken(texts).collect()} == {"b.json"}
    assert [r.text for r in files.memories(texts.filter(files.is_json(F.col("value")))).collect()] == ["x"]
    docs = files.documents(spark, str(tmp_path), ("*.md",))
    assert [(r.pos) for r in files.index(docs).orderBy("pos").collect()] == [0, 1, 2]
    assert re.match(files.glob_pattern("**/*.md"), "x/y/c.md") and not re.match(files.glob_pattern("*.md"), "x/c.md")


def test_next_run_past_the_end_of_a_month():
    assert extract.next_run("monthly", "07:00", 31, datetime(2024, 2, 1)) == datetime(2024, 2, 29, 7)
    assert extract.next_run("monthly", "07:00", 31, datetime(2024, 1, 31, 8)) == datetime(2024, 2, 29, 7)
    assert extract.next_run("daily", "9am", None, datetime(2024, 1, 1)) is None


def test_vector_first(spark):
    """Both branches against plain Python, and the query's own vectors at another threshold."""
    import random

    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    vectors = [[x / sum(y * y for y in v) ** 0.5 for x in v] for v in vectors]
    chunks = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    docs = spark.createDataFrame([(1, "open"), (2, "open license"), (3, "none"), (4, "license open software"), (5, "a license"), (6, None)], "doc_id long, text string")
    ask = lambda probe, least, k=3: {(r.doc_id, r.source) for r in search.vector_first(chunks, docs, probe, ["license", "open", "software"], k, least).collect()}
    cosine = sorted(((sum(x * y for x, y in zip(v, vectors[7], strict=True)), -i) for i, v in enumerate(vectors)), reverse=True)
    for least in (0.0, 0.5, 0.99):
        assert ask(vectors[7], least) == {(-i, "vector") for s, i in cosine[:3] if s >= least}
    assert ask([-x for x in vectors[7]], 1.01) == {(4, "words"), (2, "words"), (1, "words")}


def test_vector_first_reads_the_vectors(spark, tmp_path):
    from tessera.plans import registry

    spark.createDataFrame([(1, "license"), (2, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [-0.125] * 64), (2, [0.125] * 64)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in registry.queries()["r13_vector_first"](spark, str(tmp_path)).collect()] == [(2, "vector")]


def test_recurrence_agrees_with_dateutil():
    rrule = pytest.importorskip("dateutil.rrule")
    rng, end = random.Random(1), datetime(2032, 1, 1)
    for _ in range(300):
        freq = rng.choice(["DAILY", "WEEKLY", "MONTHLY", "YEARLY"])
        rule = f"FREQ={freq};INTERVAL={rng.randint(1, 4)};UNTIL=20320101T000000"
        if rng.random() < 0.5:
            days = {(rng.choice(["", "1", "2", "-1"]) if freq in ("MONTHLY", "YEARLY") else "") + rng.choice(extract.DAYS) for _ in range(rng.randint(1, 3))}
            rule += ";BYDAY=" + ",".join(sorted(days))
        if rng.random() < 0.3 and freq != "WEEKLY":
            rule += ";BYMONTHDAY=" + ",".join(str(rng.choice([1, 5, 15, 31, -1, -3])) for _ in range(2))
        if rng.random() < 0.2:
            rule += f";BYMONTH={rng.randint(1, 12)}"
        if rng.random() < 0.25 and "BYDAY" in rule:
            rule += ";BYSETPOS=" + rng.choice(["1", "-1", "2", "1,-1"])
        start = datetime(2024, 1, 31, 9, 30) if rng.random() < 0.3 else datetime(2024, rng.randint(1, 12), rng.randint(1, 28), 9, 30)
        got = [d for d, _ in zip(extract.occurrences(start, rule, end), range(30), strict=False)]
        assert got == [d for d, _ in zip(rrule.rrulestr(rule, dtstart=start), range(30), strict=False)], (start, rule)


def test_other_rule_parts_leave_the_single_event():
    start = datetime(2024, 1, 1)
    for rule in ("FREQ=HOURLY", "FREQ=DAILY;BYHOUR=3", "FREQ=DAILY;INTERVAL=0", "FREQ=WEEKLY;BYDAY=1MO", "nothing"):
        assert extract.expand("e", start, start, rule, datetime(2023, 1, 1), datetime(2025, 1, 1)) == [("e", start, start, False)]


@pytest.mark.parametrize(
    ("said", "want"),
    [("tomorrow", (2, 1, 0, 0)), ("tonight", (1, 31, 0, 0)), ("tonight at 8 p.m.", (1, 31, 20, 0)), ("3pm today", (1, 31, 15, 0)), ("12am", (1, 31, 0, 0)), ("next monday 9:15", (2, 5, 9, 15)), ("in 2 hrs", (1, 31, 14, 0)), ("in 45min", (1, 31, 12, 45)), ("25:00", None), ("13pm x", None)],
)
def test_moments(said, want):
    assert times.moment(said, datetime(2024, 1, 31, 12)) == (want and datetime(2024, *want))


def test_pull_priority_needs_a_path_and_a_title(spark):
    rows = [(1, "Fix auth", ["a.py"], "clean", "none"), (2, "Fix login", ["src/auth.py"], "dirty", "approved"), (3, "Expired entries", ["key_manager.py"], "", "x"), (4, "plain", ["auth.py"], None, None), (5, "security", ["b.py", "src/auth.py"], "HAS_HOOKS", "changes_requested")]
    pulls = spark.createDataFrame([(*r, "2024-01-01 00:00:00") for r in rows], "number long, title string, files array<string>, merge_state string, review_decision string, updated_at string")
    got = {r.number: r.score for r in models.pull_score(pulls, F.lit("2024-01-31 12:00:00").cast("timestamp")).collect()}
    assert got == {1: 3 + 4 + 4, 2: 45 + 3 - 8 + 4, 3: 45 + 4, 4: 4 + 4, 5: 22 + 3 + 3 + 10 + 4}


def test_chunks_overlap_by_whole_sentences():
    text = " ".join(f"Sentence number {i} has some words." for i in range(60)) + " " + "z" * 1500 + ". End."
    chunks = extract.sentence_chunks(text, 300, 80)
    assert all(len(x) <= 300 for x in chunks) and chunks[0].startswith("Sentence number 0") and chunks[-1] == "End."
    assert all(a.split(". ")[-1].rstrip(".") in b for a, b in zip(chunks[:5], chunks[1:6], strict=True))
    assert extract.chunk_borders([5, 5, 5], 11, 5) == [(0, 2), (1, 3)] and extract.chunk_borders([20, 3], 10, 2) == [(0, 1), (1, 2)]
    assert extract.chunk_borders([], 10, 2) == [] and extract.sentence_chunks("") == []
