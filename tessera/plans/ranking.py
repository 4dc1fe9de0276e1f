"""Search, ranking, duplicates and graph clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import dedup as D
from tessera.operators import models as M
from tessera.operators import relational as R
from tessera.operators import search as S
from tessera.plans import fixtures as X
from tessera.plans.registry import query
from tessera.plans.relational import _pulls

c = F.col


def _now():
    return F.lit(X.NOW).cast("timestamp")
_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"


@query(rf"""
WITH m AS (SELECT *, {_WORDS.format('text')} AS w FROM conversations WHERE role IN ('user', 'assistant')),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean, count(*) FILTER (WHERE list_contains(w, 'the')) AS d1, count(*) FILTER (WHERE list_contains(w, 'and')) AS d2 FROM m),
hits AS (SELECT conv_id, turn, text, len(w) AS length, len(list_filter(w, lambda x: x = 'and')) AS f2, len(list_filter(w, lambda x: x = 'the')) AS f1 FROM m WHERE list_contains(w, 'the') AND list_contains(w, 'and')),
scored AS (SELECT conv_id, turn, text,
  greatest(ln((n - d2 + 0.5::DOUBLE) / (d2 + 0.5::DOUBLE)), 1e-6) * f2 * 2.2::DOUBLE / (f2 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))
  + greatest(ln((n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)), 1e-6) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)) AS score FROM hits, s),
top AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, conv_id, turn) AS rank FROM scored ORDER BY rank LIMIT 20),
ctx AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations WHERE role IN ('user', 'assistant')),
cut AS (SELECT *, strpos(lower(text), 'the and') - 1 AS spot FROM top)
SELECT cut.conv_id, cut.turn, rank, round(score, 6) AS score, md5(coalesce(before, '')) AS before_md5, md5(coalesce(after, '')) AS after_md5,
  CASE WHEN spot < 0 THEN substr(text, 1, 120) ELSE (CASE WHEN spot > 60 THEN '...' ELSE '' END) || substr(text, greatest(spot - 60, 0) + 1, least(spot + 67, length(text)) - greatest(spot - 60, 0)) || (CASE WHEN spot + 67 < length(text) THEN '...' ELSE '' END) END AS snippet
FROM cut JOIN ctx ON cut.conv_id = ctx.conv_id AND cut.turn = ctx.turn
""")
def r1_transcript_search(t):
    """BM25 over turns of users and assistants, the best 20, with their neighbours and a snippet."""
    m = t.conversations.filter(c("role").isin("user", "assistant")).select("conv_id", "turn", "text", F.struct("conv_id", "turn").alias("k"))
    top = S.bm25(m, "k", c("text"), "and the").withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "k").limit(20)
    from pyspark.sql import Window

    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "k")).cast("long"))  # at most 20 rows
    # Only the conversations of hits need their turns side by side.
    near = m.join(F.broadcast(top.select(c("k.conv_id").alias("conv_id")).distinct()), "conv_id", "left_semi")
    near = R.around(near, "conv_id", "turn", c("text"), 1).join(F.broadcast(top), "k")
    side = lambda x: F.md5(F.coalesce(F.try_element_at(c(x), F.lit(1)), F.lit("")).cast("binary"))
    return near.select("conv_id", "turn", "rank", F.round("score", 6).alias("score"), side("_before").alias("before_md5"), side("_after").alias("after_md5"), T.snippet(c("text"), "the and").alias("snippet"))


@query()
def r2_web_ranking(t):
    rows = t.inline(X.WEB).withColumn("score", S.web_score("latest news sweden", _now()))
    return rows.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id")


@query(r"""
SELECT page_id, round(CASE WHEN h = '' THEN 0.0 WHEN ends_with(h, '.edu') OR ends_with(h, '.gov') THEN 1.0 WHEN ends_with(h, '.org') THEN 0.7 ELSE 0.4 END * 1.5, 6)::DOUBLE AS score
FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h FROM pages)""")
def r2c_domain_score(t):
    host = T.domain(c("url"))
    score = F.when(host == "", 0.0).when(host.isin(*S.TRUSTED) | host.endswith(".edu") | host.endswith(".gov"), 1.0).when(host.endswith(".org"), 0.7).otherwise(0.4)
    return t.pages.select("page_id", F.round(score * 1.5, 6).alias("score"))


@query()
def r3_memory_relevance(t):
    rows = S.memory_relevance(t.inline(X.MEMORIES), "Who likes green tea?")
    return rows.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(8)


@query()
def r4_memory_routing(t):
    return t.inline(X.MEMORIES).select("id", S.memory_kind("what do I like, and which task or phone is next").alias("kind"))


@query()
def r5_hybrid_memory(t):
    days = (F.unix_seconds(_now()) - F.coalesce("ts", F.lit(0))) / 86400
    vectors = t.inline(X.rows("id, similarity", "('k2', 0.8)", "('k5', 0.15)", "('k7', 0.6)"))
    rows = S.hybrid_memory(t.inline(X.MEMORIES), ["green", "tea", "walks", "tea"], "id", "text", days, vectors)
    return rows.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(5)


@query(r"""
WITH q AS (SELECT unnest(['over', 'license', 'license']) AS term),
d AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z0-9]+(?:[-_][a-z0-9]+)*)', 1), lambda w: length(w) >= 3)) AS w FROM documents),
s AS (SELECT count(*) AS n FROM d), f AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT term FROM q), d WHERE list_contains(w, term) GROUP BY term)
SELECT term, df, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 6) AS idf FROM f, s""")
def a17_document_frequency(t):
    """How many documents hold each of the query's words, and their weight."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9]+(?:[-_][a-z0-9]+)*)"), 1), lambda w: F.length(w) >= 3))
    rows = t.documents.select(words.alias("w"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    df = rows.select(F.explode("w").alias("term")).filter(c("term").isin("over", "license")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log((c("n") - c("df") + 0.5) / (c("df") + 0.5) + 1), 6).alias("idf"))  # n is one row


_TOPICS = {"The": ("the", "and"), "License": ("license", "licensed under"), "Und": ("und", "nicht"), "Le": ("le", "une")}


@query("\nUNION ALL\n".join(
    f"SELECT '{k}' AS topic, '{w}' AS keyword, count(*) AS n, count(DISTINCT conv_id) AS sessions FROM conversations WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){w}([^\\p{{L}}\\p{{N}}_]|$)') HAVING count(*) > 0" for k, ws in _TOPICS.items() for w in ws))
def a16_topic_frequency(t):
    """Pairs of message and keyword; the lexicon is short, so it becomes one array in each row."""
    hits = F.array_compact(F.array(*(F.when(T.whole_word(F.lower("text"), w), F.struct(F.lit(k).alias("topic"), F.lit(w).alias("keyword"))) for k, ws in _TOPICS.items() for w in ws)))
    rows = t.conversations.select("conv_id", F.explode(hits).alias("h"))
    return rows.groupBy("h.topic", "h.keyword").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("sessions"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 7))::DOUBLE, 4) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 7)) DESC, vec_id LIMIT 10")
def r9_vector_search(t):
    probe = t.embeddings.filter("vec_id = 7").first().embedding
    top = S.nearest(t.embeddings, "embedding", [float(x) for x in probe], 10, "vec_id")
    return top.select("vec_id", F.round("similarity", 4).alias("similarity"))


@query()
def r6_hybrid_vector(t):
    """Chunks with a vector in two lanes: vectors and texts meet on their numbers."""
    text = t.documents.select(c("doc_id").alias("vec_id"), c("text").alias("document"))
    rows = t.embeddings.join(text, "vec_id").select(c("vec_id").alias("id"), "document", "embedding", "label")
    probe = [float(x) for x in t.embeddings.filter("vec_id = 3").first().embedding]
    lanes = [rows.filter("label <= 5"), rows.filter("label >= 5")]
    return S.hybrid_vector(lanes, probe, "the and of", 5).select("id", "score", "lane")


@query("SELECT doc_id, (CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'mit') THEN 1 ELSE 0 END)::INTEGER AS score FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'mit')")
def r7_keyword_fallback(t):
    return S.keyword_fallback(t.documents, "license MIT", "text").select("doc_id", "score")


_LANES = X.rows("id, lane, score", "('a', 0, 0.9)", "('a', 1, 0.95)", "('b', 1, 0.9)", "('c', 0, 0.2)", "('b', 0, 0.9)")


@query("SELECT * FROM (VALUES ('a', 1), ('b', 0), ('c', 0)) AS t(id, lane)")
def r8_lane_merge(t):
    return R.keep_one(t.inline(_LANES), ["id"], [F.desc("score"), "lane"]).select("id", "lane")


@query("SELECT a.vec_id, max(list_cosine_similarity(a.embedding, b.embedding)) >= 0.92 AS duplicate FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id")
def r10_nearest_duplicate(t):
    """Every fiftieth vector is asked for against all others; the questions are sent to the rows, a block at a time."""
    best = S.nearest_of_each(t.embeddings, t.embeddings.filter("vec_id % 50 = 0"), "vec_id", "embedding")
    return best.select("vec_id", (c("similarity") >= 0.92).alias("duplicate"))


@query(r"""SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z0-9_-]+)', 1), lambda w: w IN ('license', 'software', 'under', 'open')))) AS score FROM documents
WHERE len(list_filter(regexp_extract_all(lower(text), '([a-z0-9_-]+)', 1), lambda w: w IN ('license', 'software', 'under', 'open'))) > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def r12_personal_retrieval(t):
    query_words = F.lit(["license", "open", "software", "under"])
    rows = t.documents.select("doc_id", F.size(F.array_intersect(T.document_words(c("text")), query_words)).cast("long").alias("score"))
    return rows.filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(20)


@query()
def r14_skill_relevance(t):
    split = lambda x: F.filter(F.split(x, ","), lambda y: y != "")
    rows = t.inline(X.SKILLS).withColumns({"tags": split(c("tags")), "procedure": split(c("procedure"))})
    return S.skill_relevance(rows, "deploy a service with docker").select("name", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "name").limit(5)


_TOOLS = X.rows("tool, near", "('mail', 0.9)", "('search', 0.7)", "('shell', 0.2)")


@query("SELECT * FROM (VALUES ('calendar'), ('mail')) AS t(tool)")
def r15_tool_retrieval(t):
    """The nearest tools, those that a word of the query forces in, less those that are switched off."""
    near = t.inline(_TOOLS).filter("near >= 0.5").agg(F.collect_set("tool").alias("tools"))
    tools = F.array_except(F.array_union("tools", F.array(F.lit("calendar"))), F.array(F.lit("search")))
    return near.select(F.explode(F.sort_array(tools)).alias("tool"))


@query("SELECT doc_id, n, first FROM (SELECT doc_id, count(*) OVER (PARTITION BY lower(trim(text))) AS n, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) = 1 AS first FROM documents) WHERE n > 1")
def n1_exact_duplicates(t):
    key = F.sha2(F.lower(F.trim("text")).cast("binary"), 256)
    return D.copies(t.documents, key, ["doc_id"]).filter("_n > 1").select("doc_id", c("_n").alias("n"), c("_first").alias("first"))


@query(f"SELECT id, row_number() OVER (PARTITION BY owner, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY ts, id) > 1 AS duplicate FROM ({X.MEMORIES})")
def n2_normalised_duplicates(t):
    from pyspark.sql import Window

    w = Window.partitionBy("owner", F.lower(T.collapsed(c("text")))).orderBy(c("ts").asc_nulls_last(), "id")
    return t.inline(X.MEMORIES).select("id", (F.row_number().over(w) > 1).alias("duplicate"))


@query(r"""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))) AS word FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM w a JOIN w b ON a.word = b.word AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id)
SELECT a, b, round(c / (x.n + y.n - c)::DOUBLE, 6) AS similarity FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE c >= 0.6 * (x.n + y.n - c)""")
def n3_fuzzy_duplicates(t):
    return D.similar(t.documents, "doc_id", T.plain_words(c("text")), 0.6).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query()
def n4_skill_duplicates(t):
    rows = t.inline(X.SKILLS).withColumn("whole", F.concat_ws(" ", "description", "when_to_use"))
    return D.similar(rows, "name", T.skill_words(c("whole")), 0.82)


@query("SELECT * FROM (VALUES ('d2', false), ('d3', true)) AS t(id, keeper)")
def n5_title_and_content(t):
    """The longest real content is kept, then the newest; an upload's own id does not count."""
    from pyspark.sql import Window

    w = Window.partitionBy(T.title_key(c("title")), T.content_key(c("content")))
    updated = F.coalesce("updated_at", "created_at")
    rows = t.inline(X.DOCUMENTS).withColumns({"n": F.count(F.lit(1)).over(w), "keeper": F.row_number().over(w.orderBy(F.desc(T.real_length(c("content"))), updated.desc_nulls_last(), "id")) == 1})
    return rows.filter("n > 1").select("id", "keeper")


@query(f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY owner, file_hash ORDER BY id) AS r FROM ({X.IMAGES})) WHERE r > 1")
def n6_content_hash(t):
    first = R.keep_one(t.inline(X.IMAGES), ["owner", "file_hash"], ["id"]).select("id")
    return t.inline(X.IMAGES).join(first, "id", "left_anti").select("id")


@query(f"SELECT b.uid FROM ({X.EVENTS}) b WHERE EXISTS (SELECT 1 FROM ({X.EVENTS}) a WHERE lower(a.summary) = lower(b.summary) AND a.dtstart = b.dtstart AND a.uid < b.uid)")
def n7_calendar_duplicates(t):
    rows = t.inline(X.EVENTS).withColumn("key", F.lower("summary"))
    first = R.keep_one(rows, ["key", "dtstart"], ["uid"]).select("uid")
    return rows.join(first, "uid", "left_anti").select("uid")


@query("SELECT count(*) AS added FROM (SELECT DISTINCT text FROM documents WHERE source <> 'src0' AND text NOT IN (SELECT text FROM documents WHERE source = 'src0'))")
def n8_insert_if_absent(t):
    rows = t.documents.withColumn("id", T.content_id(c("text")))
    return D.insert_if_absent(rows.filter("source = 'src0'"), rows.filter("source <> 'src0'"), "id", ["doc_id"]).agg(F.count(F.lit(1)).alias("added"))


@query("SELECT user_id, min(event_id) AS first_event FROM events GROUP BY user_id")
def n9_first_seen(t):
    return t.events.groupBy("user_id").agg(F.min("event_id").alias("first_event"))


@query("SELECT * FROM (VALUES (1, 1), (2, 1), (3, 3), (4, 1), (5, 3), (6, 6)) AS t(number, component)")
def g1_overlap_groups(t):
    pulls = _pulls(t)
    return D.components(pulls, D.stars(pulls.select("number", F.explode("files").alias("file")), "number", "file"), "number")


@query("SELECT * FROM (VALUES (1, 2)) AS t(a, b)")
def j15_similar_pulls(t):
    """At least half of the files and two title words in common; pairs meet on a shared file first."""
    p = _pulls(t).withColumn("w", F.filter(F.array_distinct(F.split(F.lower("title"), r"[^a-z0-9]+")), lambda x: (F.length(x) > 2) & ~x.isin("the", "and", "for", "with")))
    a, b = p.alias("a"), p.alias("b")
    pairs = D.shared_files(p).alias("p").join(a, F.expr("p.a = a.number")).join(b, F.expr("p.b = b.number"))
    fits = (T.jaccard(c("a.files"), c("b.files")) >= 0.5) & (F.size(F.array_intersect("a.w", "b.w")) >= 2)
    return pairs.filter(fits).select("p.a", "p.b")


@query("SELECT * FROM (VALUES (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6)) AS t(number, component)")
def g2_similarity_groups(t):
    return D.components(_pulls(t), j15_similar_pulls(t), "number")


@query(f"""WITH RECURSIVE walk(origin, spot, depth) AS (SELECT id, then_id, 1 FROM ({X.TASKS}) WHERE then_id IS NOT NULL
UNION ALL SELECT w.origin, n.then_id, w.depth + 1 FROM walk w JOIN ({X.TASKS}) n ON w.spot = n.id WHERE n.then_id IS NOT NULL AND w.depth < 10)
SELECT id, coalesce(max(depth), 0) >= 10 OR bool_or(coalesce(walk.spot = walk.origin, false)) AS cycle FROM ({X.TASKS}) LEFT JOIN walk ON id = walk.origin GROUP BY id""")
def g3_chain_cycle(t):
    """Ten steps along the chain; coming back, or still walking, is a cycle."""
    links = t.inline(X.TASKS).filter("then_id is not null").select(c("id").alias("k"), c("then_id").alias("next"))
    walk = t.inline(X.TASKS).select("id", c("then_id").alias("at"), F.lit(False).alias("back"))
    for _ in range(9):
        walk = walk.withColumn("back", c("back") | F.coalesce(c("at") == c("id"), F.lit(False))).join(links, c("at") == c("k"), "left").select("id", c("next").alias("at"), "back")
    return walk.select("id", (c("back") | c("at").isNotNull()).alias("cycle"))


@query()
def r18_pull_priority(t):
    return M.pull_score(_pulls(t), _now()).orderBy(F.desc("score"), "number")


_CATALOGUE = X.rows(
    "name, parameter_count, quant, context, gpu_gb", "('Qwen2.5-7B-AWQ', '7B', 'Q4_K_M', 8192, 12.0)", "('Llama-3-70B', '70B', 'Q4_K_M', 4096, 12.0)", "('tiny', '355', 'Q8_0', 2048, 12.0)",
    "('bad', '1.5.3B', 'Q4_K_M', 4096, 12.0)", "('big-fp8', '0.02T', 'FP8', 32768, 48.0)", "('mini', '500M', 'Q4_K_M', 512, 1.0)",
)


def _billions(count):
    number = F.regexp_extract(F.upper(F.trim(count)), r"^([\d.]+)\s*[BKMGT]?$", 1).try_cast("double")
    unit = F.regexp_extract(F.upper(F.trim(count)), r"([BKMGT])$", 1)
    scaled = F.when(unit == "B", number).when(unit == "M", number / 1e3).when(unit == "K", number / 1e6).when(unit == "T", number * 1e3).when(number >= 1e6, number / 1e9).otherwise(number / 1e3)
    return F.coalesce(scaled, F.lit(0.0))


@query("SELECT * FROM (VALUES ('Qwen2.5-7B-AWQ', 7.0::DOUBLE), ('Llama-3-70B', 70.0), ('tiny', 0.355), ('bad', 0.0), ('big-fp8', 20.0), ('mini', 0.5)) AS t(name, billions)")
def f33_parameter_count(t):
    return t.inline(_CATALOGUE).select("name", _billions(c("parameter_count")).alias("billions"))


@query(f"SELECT name, CASE WHEN contains(lower(name), 'awq') THEN 'AWQ-4bit' WHEN contains(lower(name), 'fp8') THEN 'FP8' ELSE '' END AS inferred FROM ({_CATALOGUE})")
def f34_quantisation(t):
    n = F.lower("name")
    eight = n.rlike("8-?bit|int8")
    inferred = F.when(n.contains("nvfp4"), "NVFP4").when(n.contains("mxfp4"), "MXFP4").when(n.rlike("(^|[-_/])nf4($|[-_/])"), "NF4").when(n.rlike("(^|[-_/])fp4($|[-_/])"), "FP4")
    inferred = inferred.when(n.rlike("(^|[-_/])w4a16($|[-_/])"), "W4A16").when(n.rlike("(^|[-_/])w8a8($|[-_/])"), "W8A8").when(n.rlike("(^|[-_/])w8a16($|[-_/])"), "W8A16")
    inferred = inferred.when(n.contains("awq"), F.when(eight, "AWQ-8bit").otherwise("AWQ-4bit")).when(n.contains("gptq"), F.when(eight, "GPTQ-Int8").otherwise("GPTQ-Int4"))
    inferred = inferred.when(n.contains("mlx"), F.when(n.contains("6bit"), "mlx-6bit").when(eight, "mlx-8bit").otherwise("mlx-4bit")).when(n.contains("fp8"), "FP8")
    return t.inline(_CATALOGUE).select("name", inferred.when(n.rlike("int4|4-?bit"), "INT4").when(eight, "INT8").otherwise("").alias("inferred"))


@query()
def r16_model_fit(t):
    """Quality, speed, fit and context, weighed for general use; what does not fit the memory scores 0 for fit."""
    rows = t.inline(_CATALOGUE).withColumn("pb", _billions(c("parameter_count")))
    bpp = F.when(c("quant") == "FP8", 1.0).when(c("quant") == "Q8_0", 1.05).otherwise(0.58)
    need = c("pb") * bpp + F.lit(8e-6) * c("pb") * c("context") + 0.5
    base = F.when(c("pb") < 1, 30).when(c("pb") < 3, 45).when(c("pb") < 7, 60).when(c("pb") < 10, 75).when(c("pb") < 20, 82).when(c("pb") < 40, 89).otherwise(95)
    name = F.lower("name")
    quality = F.least(F.lit(100), base + F.when(name.contains("qwen"), 2).otherwise(0) + F.when(name.contains("llama"), 2).otherwise(0) + F.when(name.contains("qwen2.5"), 2).otherwise(0))
    tps = F.when(c("pb") <= 0, 0.0).otherwise(F.lit(320.0) / F.greatest(c("pb") * F.lit(0.5), F.lit(1e-9)) * 0.55)
    speed, ratio = F.least(F.lit(100.0), tps / 40 * 100), need / c("gpu_gb")
    fit = F.when(ratio > 1, 0.0).when(ratio <= 0.5, 60 + ratio / 0.5 * 40).when(ratio <= 0.8, 100.0).when(ratio <= 0.9, 70.0).otherwise(50.0)
    ctx = F.when(c("context") >= 4096, 100).when(c("context") >= 2048, 70).otherwise(30)
    score = 0.45 * quality + 0.30 * speed + 0.15 * fit + 0.10 * ctx
    return rows.select("name", F.round(need, 4).alias("need_gb"), F.round(score, 4).alias("score")).orderBy(F.desc("score"), "name")


_IMAGE_MODELS = X.rows(
    "name, quality, speed, vram_bf16, vram_fp8, vram_q4, default_quant", "('a', 90, 40, 8.0::DOUBLE, 4.5::DOUBLE, 3.0::DOUBLE, 'BF16')", "('b', 95, 20, 24.0, 12.0, 7.0, 'BF16')", "('c', 60, 95, 3.0, NULL, NULL, 'BF16')", "('d', 99, 5, 60.0, 34.0, NULL, 'FP8')", "('e', 70, 50, 10.7, NULL, NULL, 'BF16')",
)


@query(f"""
WITH taken AS (
  SELECT name, gpu, quality, speed, coalesce(CASE WHEN vram_bf16 <= gpu * 0.9 THEN vram_bf16 END, CASE WHEN vram_fp8 <= gpu * 0.9 THEN vram_fp8 END, CASE WHEN vram_q4 <= gpu * 0.9 THEN vram_q4 END) AS need,
    CASE WHEN vram_bf16 <= gpu * 0.9 THEN 'BF16' WHEN vram_fp8 <= gpu * 0.9 THEN 'FP8' WHEN vram_q4 <= gpu * 0.9 THEN 'Q4' WHEN gpu > 0 THEN default_quant END AS quant
  FROM ({_IMAGE_MODELS}), (SELECT unnest([8.0::DOUBLE, 12.0, 48.0, 0.0]) AS gpu))
SELECT name, gpu, quant, round(0.6::DOUBLE * quality + 0.2::DOUBLE * speed + CASE WHEN gpu <= 0 THEN 0 WHEN need IS NULL THEN -30 WHEN gpu - need > gpu * 0.3 THEN 20 WHEN gpu - need > gpu * 0.1 THEN 10 ELSE 5 END, 1) AS score FROM taken""")
def r17_image_model_fit(t):
    models = t.inline(_IMAGE_MODELS).select("*", F.explode(F.array(*(F.lit(x) for x in (8.0, 12.0, 48.0, 0.0)))).alias("gpu"))
    return M.image_fit(models, c("gpu")).select("name", "gpu", "quant", "score").orderBy(F.desc("score"), "name", "gpu")


_BANDWIDTH = X.rows("gpu, gbps", "('rtx 4090', 1008)", "('rtx 40', 700)", "('m3 max', 400)", "('m3', 100)")


@query("SELECT * FROM (VALUES ('NVIDIA RTX 4090', 1008), ('RTX 4070', 700), ('Apple M3 Max', 400), ('unknown', NULL)) AS t(name, gbps)")
def f36_bandwidth(t):
    """The longest key that the name contains wins."""
    names = t.inline(X.rows("name", "('NVIDIA RTX 4090')", "('RTX 4070')", "('Apple M3 Max')", "('unknown')"))
    return names.join(F.broadcast(t.inline(_BANDWIDTH)), F.lower("name").contains(c("gpu")), "left").groupBy("name").agg(F.max_by("gbps", F.length("gpu")).alias("gbps"))


@query()
def q4_skill_keeper(t):
    """Same base name or Jaccard of at least 0.38; the keeper by status, uses, confidence and shorter name."""
    s = t.inline(X.SKILLS).withColumns({"base": F.regexp_replace("name", r"-\d+$", ""), "w": T.guard_words(F.concat_ws(" ", "name", "description", "when_to_use", "procedure", "tags"))})
    rank = F.when(c("status") == "published", 100000).otherwise(0) + c("uses") * 100 + F.round(F.coalesce(c("confidence").try_cast("double"), F.lit(0.0)) * 100) - F.length("name") / 1000
    s = s.withColumn("rank", rank).select("name", "base", "w", "rank")
    pairs = D.similar(s, "name", c("w"), 0.38).select("a", "b")
    based = s.alias("x").join(s.alias("y"), F.expr("x.base = y.base and x.name < y.name")).select(c("x.name").alias("a"), c("y.name").alias("b"))
    both = pairs.union(based).distinct()
    both = both.union(both.select("b", "a"))
    other = both.join(s.select(c("name").alias("b"), c("rank").alias("other")), "b").groupBy("a").agg(F.max_by("b", "other").alias("keeper"), F.max("other").alias("other"))
    return s.join(other, c("name") == c("a")).filter("other > rank").select("name", "keeper")
