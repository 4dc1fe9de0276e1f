"""Reads: filters, joins, aggregates, windows, paging and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import relational as R
from tessera.plans import fixtures as X
from tessera.plans.registry import query

c = F.col


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def s1_scan_top(t):
    return t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a_b%') OR contains(lower(p_name), 'red')")
def p1_contains_escaped(t):
    return t.part.filter(T.contains(c("p_name"), "a_b%") | T.contains(c("p_name"), "RED")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a_e%'")
def p2_contains_wildcard(t):
    return t.part.filter(T.wildcard(c("p_name"), "a_e")).select("p_partkey", "p_name")


@query("SELECT conv_id, turn FROM conversations WHERE (text ILIKE '%the%' OR role ILIKE '%the%') AND (text ILIKE '%user%' OR role ILIKE '%user%')")
def p3_every_term(t):
    return t.conversations.filter(T.every_term("the user", c("text"), c("role"))).select("conv_id", "turn")


@query(f"SELECT id FROM ({X.IMAGES}) WHERE (tags ILIKE '%cat%' OR ai_tags ILIKE '%cat%') AND (tags ILIKE '%sea%' OR ai_tags ILIKE '%sea%')")
def p4_tag_filter(t):
    return t.inline(X.IMAGES).filter(T.every_term("cat sea", c("tags"), c("ai_tags"))).select("id")


@query(f"SELECT id, CASE WHEN contains(content, '<!-- pdf_source') THEN 'pdf' WHEN language IS NULL THEN 'text' ELSE language END AS kind FROM ({X.DOCUMENTS})")
def p5_display_language(t):
    return t.inline(X.DOCUMENTS).select("id", T.display_language(c("language"), c("content")).alias("kind"))


@query(f"SELECT id FROM ({X.DOCUMENTS}) WHERE (language IS NULL OR language = 'text') AND NOT contains(content, '<!-- pdf_source')")
def p6_category_text(t):
    return t.inline(X.DOCUMENTS).filter((c("language").isNull() | (c("language") == "text")) & ~c("content").contains("<!-- pdf_source")).select("id")


@query(f"SELECT id FROM ({X.SESSIONS}) WHERE coalesce(archived, false) = false")
def p7_not_archived(t):
    return t.inline(X.SESSIONS).filter(~F.coalesce("archived", F.lit(False))).select("id")


@query("SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') AND turn NOT IN (0, 1)")
def p8_in_list(t):
    return t.conversations.filter(c("role").isin("user", "assistant") & ~c("turn").isin(0, 1)).select("conv_id", "turn", "role")


@query("SELECT page_id FROM pages WHERE url = 'http://ththre.example.com' OR starts_with(url, 'http://ththre.example.com/')")
def p9_path_boundary(t):
    at = "http://ththre.example.com"
    return t.pages.filter((c("url") == at) | c("url").startswith(f"{at}/")).select("page_id")


_TAGS = X.rows("id, tags", "(1, '[\"promo\", \"News_Letter\"]')", "(2, '[\"Marketing\"]')", "(3, 'broken')", "(4, NULL)", "(5, '[\"news-letter\"]')")


@query("SELECT * FROM (VALUES (1), (2)) AS t(id)")
def p10_json_tags(t):
    """Tags of a JSON array, lower case, _ as -, promo as marketing."""
    tags = F.transform(F.from_json("tags", "array<string>", {"mode": "PERMISSIVE"}), lambda x: F.replace(F.lower(x), F.lit("_"), F.lit("-")))
    tags = F.transform(tags, lambda x: F.when(x == "promo", "marketing").otherwise(x))
    return t.inline(_TAGS).filter(F.array_contains(tags, "marketing")).select("id")


@query("SELECT page_id FROM pages WHERE regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '(^|[.])example[.](com|org)$') AND contains(url, '/en/')")
def p11_url_filter(t):
    return t.pages.filter(T.domain(c("url")).rlike(r"(^|[.])example[.](com|org)$") & c("url").contains("/en/")).select("page_id")


@query(f"SELECT name FROM ({X.SKILLS}) WHERE status = 'published' OR (status = 'draft' AND source = 'teacher-escalation' AND contains(',' || platforms || ',', ',linux,'))")
def p12_skill_gate(t):
    """Statuses, platform, all needed tools active, no tool active that it stands in for."""
    split = lambda x: F.filter(F.split(x, ","), lambda y: y != "")
    active = F.array(F.lit("shell"), F.lit("web"))
    shown = (c("status") == "published") | ((c("status") == "draft") & (c("source") == "teacher-escalation"))
    fits = (c("platforms") == "") | F.array_contains(split(c("platforms")), "linux")
    return t.inline(X.SKILLS).filter(shown & fits & (F.size(F.array_except(split(c("needs")), active)) == 0) & ~F.arrays_overlap(split(c("fallback")), active)).select("name")


@query(f"SELECT name FROM ({X.SKILLS}) WHERE status = 'published' OR (source <> 'teacher-escalation' AND coalesce(try_cast(confidence AS DOUBLE), 1.0) >= 0.5) OR (source = 'teacher-escalation' AND coalesce(try_cast(confidence AS DOUBLE), 0.0) >= 0.5)")
def p13_confidence_gate(t):
    from tessera.operators.search import confident

    return t.inline(X.SKILLS).filter(confident(0.5)).select("name")


_LOW = ("cookie", "subscribe", "lorem", "Oneaea Oneaea")


@query("SELECT doc_id FROM documents WHERE trim(text) <> '' AND NOT (contains(lower(text), 'cookie') OR contains(lower(text), 'subscribe') OR contains(lower(text), 'lorem') OR contains(lower(text), 'oneaea oneaea'))")
def p14_low_quality(t):
    bad = F.lit(False)
    for m in _LOW:
        bad = bad | T.contains(c("text"), m)
    return t.documents.filter((F.trim("text") != "") & ~bad).select("doc_id")


@query(f"SELECT id FROM ({X.CONTACTS}) WHERE contains(lower(name), 'ann') OR contains(lower(emails), 'ann') ORDER BY id LIMIT 10")
def p15_contact_search(t):
    any_mail = F.exists(F.split("emails", ";"), lambda e: T.contains(e, "ann"))
    return t.inline(X.CONTACTS).filter(T.contains(c("name"), "ann") | any_mail).select("id").orderBy("id").limit(10)


@query("SELECT doc_id, substr(text, 1, 500) AS preview, length(text) > 500 AS cut FROM documents")
def p17_preview(t):
    return t.documents.select("doc_id", F.substring("text", 1, 500).alias("preview"), (F.length("text") > 500).alias("cut"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def j1_inner(t):
    return t.orders.join(t.customer.filter("c_mktsegment = 'BUILDING'"), c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity, c_name, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE contains(c_name, '7') AND l_quantity > 45")
def j2_three_way(t):
    hits = t.lineitem.filter("l_quantity > 45").join(t.orders, c("l_orderkey") == c("o_orderkey"))
    return hits.join(t.customer.filter(c("c_name").contains("7")), c("o_custkey") == c("c_custkey")).select("l_orderkey", "l_linenumber", "l_quantity", "c_name", "o_orderpriority")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j3_foreign_key(t):
    return t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).select("n_name", "r_name")


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j4_left(t):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j5_semi(t):
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), c("o_custkey") == c("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j6_anti(t):
    return t.customer.join(t.orders, c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey")


_UPSTREAM = X.rows("uid", "('e1')", "('e5')")


@query(f"SELECT uid FROM ({X.EVENTS}) WHERE dtstart >= '2024-01-30 00:00:00' AND dtstart < '2024-02-08 00:00:00' AND uid NOT IN (SELECT uid FROM ({_UPSTREAM}))")
def j7_windowed_prune(t):
    """Rows in the window that upstream no longer lists; with a failed parse nothing would be pruned."""
    failed = 0
    local = t.inline(X.EVENTS).filter((c("dtstart") >= "2024-01-30 00:00:00") & (c("dtstart") < "2024-02-08 00:00:00") & F.lit(failed == 0))
    return local.join(t.inline(_UPSTREAM), "uid", "left_anti").select("uid")


@query(f"SELECT s.id, coalesce((SELECT max(m.ts) FROM ({X.MESSAGES}) m WHERE m.session_id = s.id), s.last_accessed, s.created_at) AS last_at FROM ({X.SESSIONS}) s")
def j8_scalar_subquery(t):
    last = t.inline(X.MESSAGES).groupBy("session_id").agg(F.max("ts").alias("ts"))
    s = t.inline(X.SESSIONS)
    return s.join(last, s.id == last.session_id, "left").select("id", F.coalesce("ts", "last_accessed", "created_at").alias("last_at"))


@query(f"SELECT d.id, coalesce(d.owner, s.owner) AS owner FROM ({X.DOCUMENTS}) d LEFT JOIN ({X.SESSIONS}) s ON d.session_id = s.id")
def j9_backfill(t):
    d, s = t.inline(X.DOCUMENTS).alias("d"), t.inline(X.SESSIONS).alias("s")
    return d.join(s, c("d.session_id") == c("s.id"), "left").select("d.id", F.coalesce("d.owner", "s.owner").alias("owner"))


@query("SELECT rank, c_custkey, c_name FROM (VALUES (1, 7), (2, 3), (3, 11)) AS w(rank, k) JOIN customer ON c_custkey = k")
def j10_lookup_in_rank_order(t):
    wanted = t.inline(X.rows("rank, k", "(1, 7)", "(2, 3)", "(3, 11)"))
    return F.broadcast(wanted).join(t.customer, c("c_custkey") == c("k")).select("rank", "c_custkey", "c_name")


_MAIL_TAGS = X.rows("message_id, uid, tag", "('a', NULL, 'x')", "(NULL, 5, 'y')", "('b', 6, 'z')")
_MAIL = X.rows("message_id, uid", "('a', 1)", "('q', 5)", "('b', 9)", "(NULL, 6)", "('n', 7)")


@query(f"SELECT m.message_id, m.uid, coalesce(a.tag, b.tag) AS tag FROM ({_MAIL}) m LEFT JOIN ({_MAIL_TAGS}) a ON m.message_id = a.message_id LEFT JOIN ({_MAIL_TAGS}) b ON m.uid = b.uid")
def j11_two_key_lookup(t):
    m, tags = t.inline(_MAIL).alias("m"), t.inline(_MAIL_TAGS)
    out = m.join(tags.alias("a"), F.expr("m.message_id = a.message_id"), "left").join(tags.alias("b"), F.expr("m.uid = b.uid"), "left")
    return out.select("m.message_id", "m.uid", F.coalesce("a.tag", "b.tag").alias("tag"))


@query(f"SELECT uid FROM ({X.EVENTS}) WHERE dtstart < '2024-02-01 00:00:00' AND dtend > '2024-01-31 00:00:00'")
def j12_interval_overlap(t):
    return R.overlapping(t.inline(X.EVENTS), "dtstart", "dtend", F.lit("2024-01-31 00:00:00"), F.lit("2024-02-01 00:00:00")).select("uid")


@query("""WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 1800 AS f, event_type FROM events)
SELECT a.event_id AS first_id, b.event_id AS second_id FROM e a JOIN e b ON a.s < b.f AND b.s < a.f AND a.event_id < b.event_id
WHERE a.event_type = 'purchase' AND b.event_type = 'purchase'""")
def j12_interval_join(t):
    """Half-hour intervals after purchases that meet: an equi-join on hours instead of a nested loop."""
    e = t.events.filter("event_type = 'purchase'").select("event_id", F.unix_seconds(c("ts").cast("timestamp")).alias("s"))
    e = e.withColumn("f", c("s") + 1800)
    other = e.toDF("second_id", "s2", "f2")
    return R.overlap_join(e, other, ("s", "f"), ("s2", "f2"), 3600).filter("event_id < second_id").select(c("event_id").alias("first_id"), "second_id")


_WINDOWS = X.rows("label, a, b", "('today_tomorrow', '2024-01-31 00:00:00', '2024-02-02 00:00:00')", "('this_week', '2024-02-02 00:00:00', '2024-02-07 00:00:00')", "('next_30_days', '2024-02-07 00:00:00', '2024-03-01 00:00:00')")


@query(f"SELECT label, uid FROM ({X.EVENTS}) e JOIN ({_WINDOWS}) w ON e.dtstart >= w.a AND e.dtstart <= w.b WHERE status <> 'cancelled'")
def j13_digest_windows(t):
    """Contiguous windows that share their ends, both inclusive."""
    w = F.broadcast(t.inline(_WINDOWS))
    return t.inline(X.EVENTS).filter("status <> 'cancelled'").join(w, (c("dtstart") >= c("a")) & (c("dtstart") <= c("b"))).select("label", "uid")


@query("""SELECT conv_id, turn, array_to_string(coalesce(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []), ',') AS before,
array_to_string(coalesce(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), []), ',') AS after FROM conversations WHERE role IN ('user', 'assistant')""")
def j14_context_rows(t):
    out = R.around(t.conversations.filter(c("role").isin("user", "assistant")), "conv_id", "turn", c("turn").cast("string"), 3)
    return out.select("conv_id", "turn", F.array_join("_before", ",").alias("before"), F.array_join("_after", ",").alias("after"))


@query(f"SELECT a, b FROM (SELECT DISTINCT x.number AS a, y.number AS b FROM (SELECT number, unnest(string_split(files, ',')) AS f FROM ({X.PULLS}) WHERE files <> '') x JOIN (SELECT number, unnest(string_split(files, ',')) AS f FROM ({X.PULLS}) WHERE files <> '') y ON x.f = y.f AND x.number < y.number)")
def j16_shared_files(t):
    from tessera.operators.dedup import shared_files

    return shared_files(_pulls(t))


def _pulls(t):
    return t.inline(X.PULLS).withColumn("files", F.filter(F.split("files", ","), lambda f: f != ""))


@query(f"SELECT album_id, count(*) AS n, arg_max(id, created_at) AS cover FROM ({X.IMAGES}) WHERE album_id IS NOT NULL GROUP BY album_id")
def j17_album_cover(t):
    return t.inline(X.IMAGES).filter("album_id is not null").groupBy("album_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("id", "created_at").alias("cover"))


@query(f"SELECT m.id, coalesce(s.name, 'Unknown') AS session_name FROM ({X.MEMORIES}) m LEFT JOIN ({X.SESSIONS}) s ON m.session_id = s.id")
def j18_name_or_unknown(t):
    m, s = t.inline(X.MEMORIES).alias("m"), t.inline(X.SESSIONS).alias("s")
    return m.join(s, F.expr("m.session_id = s.id"), "left").select("m.id", F.coalesce("s.name", F.lit("Unknown")).alias("session_name"))


_CHAIN = X.rows("message_id, refs, reply_to", "('<a@x>', NULL, NULL)", "('<b@x>', '<a@x>', '<a@x>')", "('<c@x>', '<a@x> <b@x> <lost@x>', '<b@x>')")


@query("SELECT * FROM (VALUES ('<b@x>', '<a@x>'), ('<c@x>', '<a@x>'), ('<c@x>', '<b@x>')) AS t(message_id, parent)")
def j19_reply_chain(t):
    m = t.inline(_CHAIN)
    ids = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "refs", "reply_to"), F.lit(r"(<[^>]+>)"), 1))
    links = m.select("message_id", F.explode(ids).alias("parent"))
    return links.join(m.select(c("message_id").alias("parent")), "parent").select("message_id", "parent")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a1_facet(t):
    return R.facet(t.events, c("event_type"), "event_type")


@query(f"SELECT coalesce(language, 'text') AS language, count(*) AS n FROM ({X.DOCUMENTS}) GROUP BY 1")
def a2_facet_merge(t):
    return R.facet(t.inline(X.DOCUMENTS), F.coalesce("language", F.lit("text")), "language")


@query(f"SELECT count(DISTINCT session_id) AS sessions FROM ({X.DOCUMENTS})")
def a3_count_distinct(t):
    return t.inline(X.DOCUMENTS).agg(F.countDistinct("session_id").alias("sessions"))


@query("SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE role = 'assistant') AS answers FROM conversations GROUP BY conv_id")
def a4_two_counts(t):
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(c("role") == "assistant").alias("answers"))


@query(f"SELECT owner, coalesce(sum(file_size), 0)::BIGINT AS bytes FROM ({X.IMAGES}) GROUP BY owner")
def a5_sum_or_zero(t):
    return t.inline(X.IMAGES).groupBy("owner").agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes"))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE favorite) AS favorites, count(DISTINCT album_id) AS albums, count(*) FILTER (WHERE coalesce(tags, '') <> '') AS tagged FROM ({X.IMAGES})")
def a6_filtered_counts(t):
    return t.inline(X.IMAGES).agg(F.count(F.lit(1)).alias("total"), F.count_if("favorite").alias("favorites"), F.countDistinct("album_id").alias("albums"), F.count_if(F.coalesce("tags", F.lit("")) != "").alias("tagged"))


@query("SELECT max(o_orderdate)::VARCHAR AS newest FROM orders")
def a7_watermark(t):
    return t.orders.agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("newest"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def a8_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 12")


@query("SELECT DISTINCT p_brand, p_size FROM part")
def a9_distinct(t):
    return t.part.select("p_brand", "p_size").distinct()


@query(f"SELECT DISTINCT trim(x) AS tag FROM (SELECT unnest(string_split(tags, ',')) AS x FROM ({X.IMAGES})) WHERE trim(x) <> ''")
def a10_all_tags(t):
    return t.inline(X.IMAGES).select(F.explode(F.split("tags", ",")).alias("tag")).select(F.trim("tag").alias("tag")).filter("tag <> ''").distinct()


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang")
def a11_histogram(t):
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")


@query("SELECT lang, count(*) AS files, sum(n_chars)::BIGINT AS bytes, round_even(sum(n_chars) / 1048576.0, 2) AS mb FROM documents GROUP BY lang")
def a12_size_histogram(t):
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("bytes"), F.bround(F.sum("n_chars") / F.lit(1048576.0), 2).alias("mb"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 50) AS successes FROM events GROUP BY event_type")
def a13_counters(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(c("value") > 50).alias("successes"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') / greatest(count(*), 1)::DOUBLE AS rate FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 5")
def a14_ratio_top5(t):
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.count_if(c("event_type") == "purchase") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("rate")).orderBy(F.desc("n"), "user_id").limit(5)


@query("SELECT avg(l_extendedprice) FILTER (WHERE l_quantity > l_linenumber AND l_linenumber > 3) AS mean FROM lineitem")
def a15_conditional_mean(t):
    return t.lineitem.filter("l_quantity > l_linenumber and l_linenumber > 3").agg(F.avg("l_extendedprice").alias("mean"))


@query("SELECT role, sum(length(text))::BIGINT AS chars, sum(floor(length(text) * 0.3::DOUBLE))::BIGINT AS tokens FROM conversations GROUP BY role")
def a22_run_metrics(t):
    return t.conversations.groupBy("role").agg(F.sum(F.length("text")).alias("chars"), F.sum(T.estimate_tokens(F.length("text"))).alias("tokens"))


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING sum(length(text)) <= 250")
def a23_trivial(t):
    return t.conversations.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).filter("n <= 250").select("conv_id")


@query(f"SELECT f AS path, count(*) AS n, string_agg(number::VARCHAR, ',' ORDER BY number) AS pulls FROM (SELECT number, unnest(string_split(files, ',')) AS f FROM ({X.PULLS}) WHERE files <> '') GROUP BY f HAVING count(*) > 1")
def a18_file_heat(t):
    rows = _pulls(t).select("number", F.explode("files").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("number")), lambda x: x.cast("string")), ",").alias("pulls"))
    return rows.filter("n > 1")


@query(f"SELECT split_part(files, '/', 1) AS area, count(*) AS n, CASE WHEN count(*) >= 4 THEN 'critical' WHEN count(*) >= 2 THEN 'high' ELSE 'watch' END AS priority FROM ({X.PULLS}) GROUP BY 1")
def a19_area_rollup(t):
    rows = t.inline(X.PULLS).groupBy(F.split_part("files", F.lit("/"), F.lit(1)).alias("area")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("priority", F.when(c("n") >= 4, "critical").when(c("n") >= 2, "high").otherwise("watch"))


@query("SELECT source, sha256(string_agg(doc_id::VARCHAR || ':' || lang, '|' ORDER BY doc_id::VARCHAR || ':' || lang)) AS fingerprint FROM documents GROUP BY source")
def a20_set_fingerprint(t):
    each = F.concat(c("doc_id").cast("string"), F.lit(":"), c("lang"))
    return t.documents.groupBy("source").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(each)), "|").cast("binary"), 256).alias("fingerprint"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def a21_tally(t):
    return t.labels.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


_HEALTH = X.rows("service, status", "('db', 'ok')", "('mail', 'degraded')", "('vector', 'down')", "('web', 'ok')")


@query("SELECT 'down' AS overall")
def a24_worst_status(t):
    rank = F.create_map(*[F.lit(x) for kv in (("ok", 0), ("degraded", 1), ("down", 2)) for x in kv])
    return t.inline(_HEALTH).agg(F.max_by("status", rank[c("status")]).alias("overall"))


@query("SELECT conv_id, text FROM conversations WHERE turn = 0")
def w1_keep_oldest(t):
    return R.keep_one(t.conversations, ["conv_id"], ["turn"]).select("conv_id", "text")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def w2_keep_best(t):
    return R.keep_one(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def w3_first_wins(t):
    return t.documents.groupBy(F.sha2(c("text").cast("binary"), 256)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT conv_id, max(turn) AS latest, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def w4_latest_version(t):
    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("latest"), F.max_by("role", "turn").alias("role"))


@query("SELECT conv_id, arg_min(text, turn) AS first_text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def w5_first_user_message(t):
    return t.conversations.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r <= 5 AND n >= 3")
def w7_newest_five(t):
    return R.first_rows(t.events, ["user_id"], [F.desc("ts"), "event_id"], 5, 3).select("user_id", "event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10) AND o_totalprice > 400000")
def w8_protect_newest(t):
    newest = t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey")
    return t.orders.filter("o_totalprice > 400000").join(F.broadcast(newest), "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM events")
def w9_trailing_count(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.unix_seconds(c("ts").cast("timestamp"))).rangeBetween(-3600, 0)
    return t.events.select("event_id", F.count(F.lit(1)).over(w).alias("recent"))


@query("SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM conversations) WHERE s <= 2000")
def w12_token_budget(t):
    return R.newest_suffix(t.conversations, "conv_id", "turn", F.length("text"), 2000).select("conv_id", "turn")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts DESC, event_id) AS r, ts
FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 300)) WHERE r = 1 ORDER BY ts DESC, event_id LIMIT 100""")
def w13_minute_dedupe(t):
    fetched = t.events.orderBy(F.desc("ts"), "event_id").limit(300).withColumn("minute", F.date_trunc("minute", "ts"))
    return R.keep_one(fetched, ["user_id", "minute"], [F.desc("ts"), "event_id"]).orderBy(F.desc("ts"), "event_id").limit(100).select("user_id", "event_id")


@query("SELECT conv_id, turn FROM (SELECT *, lag(role, 1) OVER w AS b, lag(role, 2) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND b = 'user' AND a = 'assistant'")
def w15_merge_assistant(t):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.withColumns({"b": F.lag("role", 1).over(w), "a": F.lag("role", 2).over(w)}).filter("role = 'assistant' and b = 'user' and a = 'assistant'").select("conv_id", "turn")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def o1_page(t):
    return R.page(t.customer.select("c_custkey", "c_name", "c_acctbal"), [F.desc("c_acctbal"), "c_custkey"], 40, 20)


@query(f"SELECT id FROM ({X.DOCUMENTS}) ORDER BY updated_at DESC NULLS LAST, id LIMIT 5")
def o2_named_sort(t):
    order = {"recent": [c("updated_at").desc_nulls_last()], "oldest": [c("created_at").asc_nulls_last()], "edits": [F.desc("version_count")], "alpha": [F.lower("title")]}
    return t.inline(X.DOCUMENTS).orderBy(*order["recent"], "id").limit(5).select("id")


@query("SELECT p_partkey FROM part ORDER BY p_size DESC, p_brand ASC, p_retailprice DESC, p_partkey LIMIT 30")
def o3_multi_key(t):
    return t.part.orderBy(F.desc("p_size"), "p_brand", F.desc("p_retailprice"), "p_partkey").limit(30).select("p_partkey")


@query()
def o4_seeded_shuffle(t):
    return t.part.orderBy(F.xxhash64("p_partkey", F.lit(42)), "p_partkey").limit(50).select("p_partkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY CASE WHEN starts_with(c_name, 'Customer#00000001') THEN 0 ELSE 1 END, lower(c_name), c_custkey LIMIT 15")
def o5_prefix_first(t):
    first = F.when(c("c_name").startswith("Customer#00000001"), 0).otherwise(1)
    return t.customer.orderBy(first, F.lower("c_name"), "c_custkey").limit(15).select("c_custkey", "c_name")


@query("SELECT kind, k, amount FROM (SELECT 'c' AS kind, c_custkey AS k, c_acctbal AS amount FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier) ORDER BY amount DESC NULLS LAST, kind, k LIMIT 20")
def o6_merge_sources(t):
    a = t.customer.select(F.lit("c").alias("kind"), c("c_custkey").alias("k"), c("c_acctbal").alias("amount"))
    b = t.supplier.select(F.lit("s").alias("kind"), c("s_suppkey").alias("k"), c("s_acctbal").alias("amount"))
    return a.unionByName(b).orderBy(c("amount").desc_nulls_last(), "kind", "k").limit(20)


_MODELS = X.rows("name", "('Qwen3.5-7B')", "('Qwen2.5-7B')", "('Llama-70B')", "('model10')", "('model9')")


@query(f"SELECT name, coalesce(try_cast(regexp_extract(name, '(\\d+\\.\\d+)', 1) AS DOUBLE), 0.0) AS version FROM ({_MODELS})")
def o8_version_key(t):
    return t.inline(_MODELS).select("name", F.coalesce(F.regexp_extract("name", r"(\d+\.\d+)", 1).try_cast("double"), F.lit(0.0)).alias("version"))


@query(f"SELECT name, row_number() OVER (ORDER BY regexp_extract(lower(name), '^(\\D*)', 1), coalesce(try_cast(regexp_extract(name, '(\\d+)', 1) AS BIGINT), 0), name) AS place FROM ({_MODELS})")
def o9_natural_order(t):
    from pyspark.sql import Window

    w = Window.orderBy(F.regexp_extract(F.lower("name"), r"^(\D*)", 1), F.coalesce(F.regexp_extract("name", r"(\d+)", 1).try_cast("long"), F.lit(0)), "name")
    return t.inline(_MODELS).select("name", F.row_number().over(w).cast("long").alias("place"))


@query("""SELECT doc_id FROM (SELECT doc_id, min(part) AS part FROM (SELECT doc_id, 0 AS part FROM documents WHERE contains(lower(text), 'license') UNION ALL SELECT doc_id, 1 FROM documents WHERE contains(lower(text), 'the')) GROUP BY doc_id)
ORDER BY part, doc_id LIMIT 40""")
def e1_priority_union(t):
    d = t.documents.select("doc_id", "text")
    parts = [d.filter(T.contains(c("text"), "license")).select("doc_id"), d.filter(T.contains(c("text"), "the")).select("doc_id")]
    return R.union_by_priority(parts, "doc_id", ["doc_id"], 40)


@query("SELECT conv_id, array_to_string(list_sort(list(DISTINCT role) FILTER (WHERE role <> 'system')), ',') AS roles FROM conversations GROUP BY conv_id")
def e2_union_minus(t):
    roles = F.array_except(F.collect_set("role"), F.array(F.lit("system")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.sort_array(roles), ",").alias("roles"))


@query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def e3_union_distinct(t):
    return t.customer.select(c("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01')")
def e5_new_keys(t):
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    seen = t.orders.filter(c("o_orderdate") < day("1993-01-01")).select("o_custkey").distinct()
    return t.orders.filter(c("o_orderdate") >= day("1998-01-01")).select("o_custkey").distinct().join(seen, "o_custkey", "left_anti")


@query(f"SELECT * FROM (VALUES ('s1', true, false), ('s5', false, true), ('s8', true, true)) AS t(id, shared_alice, legacy_null) WHERE id = 'zz' UNION ALL SELECT id, owner = 'alice' OR owner IS NULL, owner IS NULL FROM ({X.SESSIONS})")
def tenancy_variants(t):
    return t.inline(X.SESSIONS).select("id", F.coalesce(R.tenancy(c("owner"), "alice", "shared"), F.lit(False)).alias("shared_alice"), R.tenancy(c("owner"), None, "legacy").alias("legacy_null"))


@query("SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS in_debt, (SELECT count(*) FROM orders) AS orders")
def q1_scalar_counts(t):
    a = t.customer.agg(F.count(F.lit(1)).alias("customers"), F.count_if(c("c_acctbal") < 0).alias("in_debt"))
    return a.crossJoin(t.orders.agg(F.count(F.lit(1)).alias("orders")))  # one row each


@query("SELECT lang, count(*) AS documents, sum(CASE WHEN length(trim(text, ' ' || chr(9) || chr(13) || chr(10))) > 0 THEN 1 + ceil(greatest(length(trim(text, ' ' || chr(9) || chr(13) || chr(10))) - 1000, 0) / 800.0) ELSE 0 END)::BIGINT AS chunks FROM documents GROUP BY lang")
def q3_index_statistics(t):
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size(T.windows(c("text")))).cast("long").alias("chunks"))


_CURATED = X.rows("prefix, place", "('gpt-4', 0)", "('gpt-4o', 1)", "('claude', 2)")
_IDS = X.rows("id", "('gpt-4o-mini')", "('gpt-4-turbo')", "('claude-x')", "('llama')")


@query("SELECT * FROM (VALUES ('gpt-4o-mini', 1), ('gpt-4-turbo', 0), ('claude-x', 2), ('llama', NULL)) AS t(id, place)")
def q5_longest_prefix(t):
    ids, p = t.inline(_IDS), F.broadcast(t.inline(_CURATED))
    return ids.join(p, c("id").startswith(c("prefix")), "left").groupBy("id").agg(F.max_by("place", F.length("prefix")).alias("place"))


@query(f"SELECT id FROM ({X.SESSIONS}) ORDER BY coalesce(last_accessed, updated_at, created_at) DESC NULLS LAST, id LIMIT 6")
def q7_timestamp_fallback(t):
    return t.inline(X.SESSIONS).orderBy(F.coalesce("last_accessed", "updated_at", "created_at").desc_nulls_last(), "id").limit(6).select("id")


@query("SELECT user_id, max(ts)::VARCHAR AS last FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 20")
def q9_newest_keys(t):
    rows = t.events.filter(c("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).groupBy("user_id").agg(F.max("ts").alias("last"))
    top = rows.orderBy(F.desc("last"), "user_id").limit(20)
    return top.select("user_id", F.regexp_replace(c("last").cast("string"), "T", " ").alias("last"))


@query("SELECT event_type, event_id, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r <= 8")
def q11_tiered_report(t):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type")
    rows = t.events.withColumns({"r": F.row_number().over(w.orderBy(F.desc("value"), "event_id")), "n": F.count(F.lit(1)).over(w)})
    return rows.filter("r <= 8").select("event_type", "event_id", "n")


@query(f"SELECT a.uid, b.uid AS reuse FROM ({X.EVENTS}) a JOIN ({X.EVENTS}) b ON a.dtstart = b.dtstart AND lower(a.summary) = lower(b.summary) AND a.uid > b.uid AND b.status <> 'cancelled'")
def q17_event_exists(t):
    a, b = t.inline(X.EVENTS).alias("a"), t.inline(X.EVENTS).filter("status <> 'cancelled'").alias("b")
    return a.join(b, F.expr("a.dtstart = b.dtstart and lower(a.summary) = lower(b.summary) and a.uid > b.uid")).select("a.uid", c("b.uid").alias("reuse"))


@query(f"SELECT id FROM ({X.IMAGES}) WHERE coalesce(tags, '') = '' ORDER BY id LIMIT 50")
def q15_untagged(t):
    return t.inline(X.IMAGES).filter(F.coalesce("tags", F.lit("")) == "").orderBy("id").limit(50).select("id")


_SHOWN = X.rows("id, cached, hidden", "(1, '[\"a\",\"b\",\"a\"]', '[\"b\"]')", "(2, 'broken', '[]')", "(3, '[\"x\"]', NULL)")


@query("SELECT * FROM (VALUES (1, 'a,a'), (2, ''), (3, 'x')) AS t(id, models)")
def q18_list_difference(t):
    """Keeps repetitions, unlike a set difference; unreadable lists are empty."""
    read = lambda x: F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))
    rows = t.inline(_SHOWN).select("id", read(c("cached")).alias("a"), read(c("hidden")).alias("b"))
    return rows.select("id", F.array_join(F.filter("a", lambda x: ~F.array_contains("b", x)), ",").alias("models"))


_VOTES = X.rows("id, winner, mapping", "(1, 'left', '{\"left\": \"m1\", \"right\": \"m2\"}')", "(2, 'tie', '{\"left\": \"m1\", \"right\": \"m2\"}')")


@query("SELECT * FROM (VALUES (1, 'm1'), (2, 'tie')) AS t(id, model)")
def q19_vote_unblind(t):
    return t.inline(_VOTES).select("id", F.coalesce(F.try_element_at(F.from_json("mapping", "map<string,string>"), c("winner")), c("winner")).alias("model"))


@query("SELECT DISTINCT p_brand, p_type FROM part ORDER BY p_brand, p_type")
def q26_catalogue(t):
    return t.part.select("p_brand", "p_type").distinct().orderBy("p_brand", "p_type")
