"""Queries: scalar text, date, payload and vector functions over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import arrow as AR, payload as P, text as T, vectors as X
from ..operators import vocab as VO
from ..sources import views as V
from .oracle_views import clean_body_sql, lst
from .registry import query

KO = "CASE WHEN len(regexp_extract_all({0}, '[가-힣a-zA-Z0-9]{{2,}}')) = 0 THEN [''] ELSE regexp_extract_all({0}, '[가-힣a-zA-Z0-9]{{2,}}') END"
WORDS = r"list_distinct(regexp_extract_all(coalesce({0}, ''), '[\p{{L}}\p{{N}}_]+'))"
ALNUM = "list_distinct(regexp_extract_all(coalesce({0}, ''), '[가-힣a-zA-Z0-9]+'))"


def jac(a: str, b: str) -> str:
    u = f"len(list_distinct(list_concat({a}, {b})))"
    return f"round(CASE WHEN {u} = 0 THEN CAST(0 AS DOUBLE) ELSE len(list_intersect({a}, {b})) / CAST({u} AS DOUBLE) END, 6)"


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query("tokenize_ko", f"SELECT article_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT article_id, {KO.format('full_text')} AS t FROM articles)")
def _(spark, d):
    return V.articles(spark, d).select("article_id", T.tokenize_ko(F.col("full_text")).alias("t")).select(
        "article_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("word_set", f"SELECT article_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT article_id, {WORDS.format('full_text')} AS t FROM articles)")
def _(spark, d):
    return V.articles(spark, d).select("article_id", T.word_set(F.col("full_text")).alias("t")).select(
        "article_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@query("jaccard", f"SELECT article_id, {jac(WORDS.format('title'), WORDS.format('summary_text'))} AS similarity FROM articles")
def _(spark, d):
    return V.articles(spark, d).select("article_id", F.round(T.jaccard(F.col("title"), F.col("summary_text")), 6).alias("similarity"))


@query("jaccard_alnum", f"SELECT article_id, {jac(ALNUM.format('title'), ALNUM.format('full_text'))} AS similarity FROM articles")
def _(spark, d):
    return V.articles(spark, d).select("article_id", F.round(T.jaccard_alnum(F.col("title"), F.col("full_text")), 6).alias("similarity"))


@query("token_set_ops", f"""SELECT article_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS common, CAST(len(list_distinct(list_concat(a, b))) AS BIGINT) AS total
  FROM (SELECT article_id, {WORDS.format('title')} AS a, {WORDS.format('full_text')} AS b FROM articles)""")
def _(spark, d):
    a, b = T.word_set(F.col("title")), T.word_set(F.col("full_text"))
    return V.articles(spark, d).select("article_id", F.size(F.array_intersect(a, b)).cast("bigint").alias("common"),
                                       F.size(F.array_union(a, b)).cast("bigint").alias("total"))


@query("collapse_ws", r"SELECT article_id, md5(trim(regexp_replace(full_text, '\s+', ' ', 'g'))) AS digest FROM articles")
def _(spark, d):
    return V.articles(spark, d).select("article_id", F.md5(T.collapse_ws(F.col("full_text"))).alias("digest"))


_LEAD = ["^\\s*\\[제목\\]\\s*", "^\\s*\\[.*?\\]\\s*", "^\\s*[가-힣a-zA-Z\\s]+(?:일보|신문|뉴스|방송|미디어)\\s*(?:=\\s*)?"] * 2
_lead = "'[제목] [' || source || '] 우리동네일보 = ' || full_text"
for _p in _LEAD:
    _lead = f"regexp_replace({_lead}, '{_p}', '')"


@query("clean_leading_noise", f"SELECT article_id, md5({_lead}) AS digest FROM articles")
def _(spark, d):
    noisy = F.concat(F.lit("[제목] ["), "source", F.lit("] 우리동네일보 = "), "full_text")
    return V.articles(spark, d).select("article_id", F.md5(T.clean_leading_noise(noisy)).alias("digest"))


@query("blank_title_chunks", """SELECT chunk_id, '' AS chunk_text FROM (SELECT chunk_id || '_title' AS chunk_id FROM chunks)
  UNION ALL SELECT chunk_id || '_0', chunk_text FROM chunks""")
def _(spark, d):
    from ..plans import ingest as G
    c = V.chunks(spark, d)
    both = c.withColumn("chunk_id", F.concat("chunk_id", F.lit("_title"))).unionByName(c.withColumn("chunk_id", F.concat("chunk_id", F.lit("_0"))))
    return G.blank_title_chunks(both).select("chunk_id", "chunk_text")


@query("clean_title", f"""SELECT article_id, {STRIP.format("regexp_replace(regexp_replace(' [단독] ' || title || ' (풀영상) ', '\\(풀영상\\)', '', 'g'), '\\[.*?\\]', '', 'g')")} AS clean FROM articles""")
def _(spark, d):
    return V.articles(spark, d).select("article_id", T.clean_title(F.concat(F.lit(" [단독] "), "title", F.lit(" (풀영상) "))).alias("clean"))


@query("clean_reporter", """SELECT article_id, CASE WHEN source = '미상' THEN '미상' ELSE split_part(source, ' ', 1) END AS reporter,
  CASE WHEN source = '미상' THEN '미상' ELSE split_part(source, ' ', 1) END || ' 기자' AS shown FROM articles""")
def _(spark, d):
    name = T.clean_reporter(F.when(F.col("source") != "미상", F.concat("source", F.lit(" (서울) 기자"))).otherwise(F.lit(" 기자 ")))
    return V.articles(spark, d).select("article_id", name.alias("reporter"), T.reporter_suffix(name).alias("shown"))


@query("strip_tags", "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest FROM pages")
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("digest"))


@query("parse_news_date", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M')
  WHEN 1 THEN CASE WHEN hour(ts) = 0 THEN strftime(ts, '%Y-%m-%d 12:%M') ELSE strftime(ts, '%Y-%m-%d %H:%M') END
  WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M') END AS parsed FROM events""")
def _(spark, d):
    i, half = F.col("event_id") % 4, F.when(F.hour("ts") < 12, "오전").otherwise("오후")
    h12 = F.when(F.hour("ts") % 12 == 0, 12).otherwise(F.hour("ts") % 12)
    raw = (F.when(i == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
           .when(i == 1, F.concat(F.date_format("ts", "yyyy.MM.dd. "), half, F.lit(" "), h12, F.date_format("ts", ":mm")))
           .when(i == 2, F.concat(F.date_format("ts", "yyyy.MM.dd. HH:mm"))).otherwise(F.lit("어제")))
    return V.table(spark, d, "events").select("event_id", F.date_format(T.parse_news_date(raw), "yyyy-MM-dd HH:mm").alias("parsed"))


@query("parse_iso", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(epoch_us(ts) AS BIGINT) WHEN 1 THEN CAST(epoch_us(ts) AS BIGINT) - 32400000000 END AS micros FROM events""")
def _(spark, d):
    i, iso = F.col("event_id") % 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = F.when(i == 0, F.concat(iso, F.lit("Z"))).when(i == 1, F.concat(iso, F.lit("+09:00"))).otherwise(F.lit("no date"))
    return V.table(spark, d, "events").select("event_id", F.unix_micros(T.parse_iso(raw)).alias("micros"))


@query("trim_middle", f"""SELECT article_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS digest FROM (SELECT article_id, CASE WHEN length(full_text) > 4000
  THEN substr(full_text, 1, 2500) || chr(10) || chr(10) || '...(중략)...' || chr(10) || chr(10) || right(full_text, 1500) ELSE full_text END AS t FROM articles)""")
def _(spark, d):
    t = T.trim_middle(F.col("full_text"))
    return V.articles(spark, d).select("article_id", F.char_length(t).cast("bigint").alias("chars"), F.md5(t).alias("digest"))


@query("trim_sentences", rf"""SELECT article_id, md5({STRIP.format("CASE WHEN len(s) <= 3 THEN full_text ELSE array_to_string(s[1:3], '') END")}) AS digest
  FROM (SELECT article_id, full_text, regexp_extract_all(full_text, '[^.!?]+[.!?]+(?:\s+|$)') AS s FROM articles)""")
def _(spark, d):
    return V.articles(spark, d).select("article_id", F.md5(T.trim_sentences(F.col("full_text"), 3)).alias("digest"))


SENTENCES = r"list_filter(regexp_split_to_array(regexp_replace(full_text, '([.!?。！？] )([가-힣A-Z])', '\1' || chr(1) || '\2', 'g'), '[' || chr(10) || chr(1) || ']'), lambda x: x <> '')"


@query("split_sentences", f"SELECT article_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT article_id, {SENTENCES} AS s FROM articles)")
def _(spark, d):
    return V.articles(spark, d).select("article_id", T.split_sentences(F.col("full_text")).alias("s")).select(
        "article_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("keyword_leaf", """SELECT article_id, CASE WHEN keywords LIKE '["정치%' THEN '홍길동,경제'
  WHEN keywords LIKE '["a%' THEN CASE WHEN length(full_text) < 500 THEN 'b,c,f' ELSE 'b,c,f,g' END ELSE '' END AS leaves FROM articles""")
def _(spark, d):
    leaves = P.keyword_leaves(F.col("keywords"), F.char_length(F.coalesce("full_text", "summary_text")))
    return V.articles(spark, d).select("article_id", F.array_join(leaves, ",").alias("leaves"))


@query("parse_event_json", "SELECT log_id, json_extract_string(event_data, '$.source') AS source, json_extract_string(event_data, '$.rec_source') AS rec_source FROM event_log")
def _(spark, d):
    v = P.parse_object(F.col("event_data"))
    return V.event_log(spark, d).select("log_id", F.try_variant_get(v, "$.source", "string").alias("source"),
                                        F.try_variant_get(v, "$.rec_source", "string").alias("rec_source"))


@query("redact_json", """SELECT log_id, '{"api_key": "[REDACTED]", "nested": {"Token": "[REDACTED]", "n": [' || length(log_id) || ', "ok"]}, "payload": ' || replace(replace(replace(event_data, '},{', '}, {'), '":', '": '), ',"', ', "') || '}' AS event_data FROM event_log""")
def _(spark, d):
    return V.raw_events(spark, d).select("log_id", AR.redact_json("event_data").alias("event_data"))


@query("clean_news_body", f"SELECT article_id, {clean_body_sql('full_text')} AS body FROM articles")
def _(spark, d):
    from ..plans import ingest as G
    return G.clean_bodies(V.articles(spark, d).select("article_id", F.col("full_text").alias("body")), "body")


@query("subject_key", "SELECT log_id, CASE WHEN user_id IS NOT NULL THEN 'user:' || user_id ELSE 'session:' || session_id END AS subject FROM event_log")
def _(spark, d):
    return V.event_log(spark, d).select("log_id", P.subject_key(F.col("user_id"), F.col("session_id")).alias("subject"))


_JUDGES = list(K.JUDGE_LABELS) + ["모름"]
_VALUES = "[" + ", ".join(str(v) for v in list(K.JUDGE_LABELS.values()) + [0.5]) + "]"


@query("judge_to_label", f"SELECT article_id, CAST({_VALUES}[CAST(article_id AS BIGINT) % 7 + 1] AS DOUBLE) AS label FROM articles")
def _(spark, d):
    judge = F.element_at(F.array(*[F.lit(f" {j} ") for j in _JUDGES]), (F.col("article_id").cast("bigint") % 7).cast("int") + 1)
    return V.articles(spark, d).select("article_id", T.judge_to_label(judge).alias("label"))


@query("label_group", "SELECT article_id, CASE WHEN label >= 0.75 THEN 'trust' WHEN label <= 0.25 THEN 'distrust' ELSE 'neutral' END AS label_group FROM label_rows")
def _(spark, d):
    return V.labels(spark, d).select("article_id", T.label_group(F.col("label")).alias("label_group"))


@query("length_bucket", "SELECT article_id, CASE WHEN length(full_text) < 500 THEN 'short' WHEN length(full_text) < 1200 THEN 'medium' ELSE 'long' END AS bucket FROM articles")
def _(spark, d):
    return V.articles(spark, d).select("article_id", T.length_bucket(F.col("full_text")).alias("bucket"))


@query("contextual_prefix", "SELECT article_id, '[제목: ' || title || '] [출처: ' || source || '] [카테고리: ' || coalesce(category, '일반') || ']' || chr(10) || lang AS prefixed FROM articles")
def _(spark, d):
    return V.articles(spark, d).select("article_id", T.contextual_prefix(F.col("title"), F.col("source"), F.coalesce("category", F.lit("일반")), F.col("lang")).alias("prefixed"))


@query("embedding_input_text", "SELECT article_id, coalesce(title, '') || chr(10) || coalesce(summary_text, '') AS input FROM articles")
def _(spark, d):
    return V.articles(spark, d).select("article_id", T.embedding_input_text(F.col("title"), F.col("summary_text")).alias("input"))


# Source strings of the fact-check sheet, made from every article.
_SRC = """CASE CAST(article_id AS BIGINT) % 6 WHEN 0 THEN source WHEN 1 THEN source || ' "' || substr(title, 1, 30) || '" 기사' WHEN 2 THEN '다수 언론'
  WHEN 3 THEN '대통령 국회 발언' WHEN 4 THEN source || ' <' || substr(title, 1, 20) || '>' ELSE '길거리 대화' END"""
_HINT = """CASE WHEN regexp_extract(src, '["“”](.{10,80})["“”]', 1) <> '' THEN trim(regexp_extract(src, '["“”](.{10,80})["“”]', 1)) WHEN regexp_extract(src, '[<＜](.{5,60})[>＞]', 1) <> '' THEN trim(regexp_extract(src, '[<＜](.{5,60})[>＞]', 1)) ELSE '' END"""
_HAS = lambda words: f"len(list_filter({lst(words)}, lambda w: contains(src, w))) > 0"
CLASSIFIED = f"""SELECT article_id, title, src, type, CASE WHEN type IN ('TYPE_A', 'TYPE_B') THEN outlet0 ELSE '' END AS outlet,
  CASE WHEN type = 'TYPE_A' THEN hint0 ELSE '' END AS article_hint,
  CASE type WHEN 'SKIP' THEN '' WHEN 'TYPE_A' THEN hint0 ELSE trim(title) END AS search_query FROM (
  SELECT *, CASE WHEN {_HAS(K.UNCRAWLABLE_WORDS)} THEN 'SKIP' WHEN {_HAS(K.SELF_RAISED_WORDS)} THEN 'TYPE_C'
    WHEN outlet0 IS NULL THEN CASE WHEN {_HAS(K.SPEECH_WORDS)} THEN 'TYPE_D' ELSE 'SKIP' END
    WHEN hint0 <> '' THEN 'TYPE_A' ELSE 'TYPE_B' END AS type FROM (
    SELECT *, list_filter({lst(K.KNOWN_OUTLETS)}, lambda w: contains(src, w))[1] AS outlet0, {_HINT} AS hint0 FROM (
      SELECT article_id, title, trim({_SRC}) AS src FROM articles)))"""


def fact_check_rows(spark, d):
    i = F.col("article_id").cast("bigint") % 6
    src = (F.when(i == 0, F.col("source")).when(i == 1, F.concat("source", F.lit(' "'), F.substring("title", 1, 30), F.lit('" 기사')))
           .when(i == 2, "다수 언론").when(i == 3, "대통령 국회 발언")
           .when(i == 4, F.concat("source", F.lit(" <"), F.substring("title", 1, 20), F.lit(">"))).otherwise("길거리 대화"))
    rows = V.articles(spark, d).select("article_id", "title", src.alias("src"))
    return rows.select("article_id", "title", T.classify_source(F.col("src"), F.col("title")).alias("c")).select("article_id", "title", "c.*")


@query("classify_source", "SELECT article_id, type, outlet, article_hint, search_query FROM classified", {"classified": CLASSIFIED})
def _(spark, d):
    return fact_check_rows(spark, d).drop("title")


@query("type_counts", "SELECT type, count(*) AS n, CAST(sum(CASE WHEN type <> 'SKIP' THEN 1 ELSE 0 END) AS BIGINT) AS crawlable FROM classified GROUP BY type", {"classified": CLASSIFIED})
def _(spark, d):
    return fact_check_rows(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.sum((F.col("type") != "SKIP").cast("bigint")).alias("crawlable"))


# ---- vectors -------------------------------------------------------------------------

@query("cosine", "SELECT a.article_id, round(list_cosine_similarity(embedding, learned_embedding), 6) AS cosine FROM article_vectors a JOIN learned_vectors l ON a.article_id = l.article_id")
def _(spark, d):
    j = V.article_vectors(spark, d).join(V.learned_vectors(spark, d), "article_id")
    return j.select("article_id", F.round(X.cosine(F.col("embedding"), F.col("learned_embedding")), 6).alias("cosine"))


@query("l2_normalize", "SELECT article_id, round(embedding[1] / sqrt(list_dot_product(embedding, embedding)), 6) AS first, round(list_sum(embedding) / sqrt(list_dot_product(embedding, embedding)), 6) AS total FROM article_vectors")
def _(spark, d):
    u = V.article_vectors(spark, d).select("article_id", X.l2_normalize(F.col("embedding")).alias("u"))
    return u.select("article_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("blend_vectors", """SELECT a.article_id, round(CASE WHEN CAST(a.article_id AS BIGINT) % 5 = 0 THEN embedding[1] ELSE embedding[1] * 0.65 + learned_embedding[1] * (1 - 0.65) END, 6) AS first
  FROM article_vectors a JOIN learned_vectors l ON a.article_id = l.article_id""")
def _(spark, d):
    j = V.article_vectors(spark, d).join(V.learned_vectors(spark, d), "article_id")
    other = F.when(F.col("article_id").cast("bigint") % 5 != 0, F.col("learned_embedding")).otherwise(F.array_repeat(F.lit(0.0), V.VECTOR_DIM))
    return j.select("article_id", F.round(X.blend_vectors(F.col("embedding"), other, K.SHORT_TERM_WEIGHT)[0], 6).alias("first"))


_FMT = "'[' || array_to_string(list_transform(CAST(embedding AS DOUBLE[]), lambda x: printf('%.6f', x)), ',') || ']'"


@query("format_vector", f"SELECT vec_id, {_FMT} AS text FROM embeddings")
def _(spark, d):
    return V.table(spark, d, "embeddings").select("vec_id", X.format_vector(X.as_double(F.col("embedding"))).alias("text"))


@query("parse_vector", f"""SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN 70 END AS dim, CASE WHEN vec_id % 7 <> 0 THEN round(list_sum(CAST({_FMT} AS DOUBLE[])), 6) END AS total FROM embeddings""")
def _(spark, d):
    text = F.when(F.col("vec_id") % 7 == 0, F.lit("not a vector")).otherwise(X.format_vector(X.as_double(F.col("embedding"))))
    v = V.table(spark, d, "embeddings").select("vec_id", X.parse_vector(text, 70).alias("v"))
    dim = F.when(F.col("v").isNotNull(), F.size("v"))
    return v.select("vec_id", dim.alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("category_vocab", "SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT coalesce(category, 'unknown') AS category FROM articles)")
def _(spark, d):
    return VO.category_vocab(V.articles(spark, d))


@query("one_hot", """SELECT article_id, array_to_string([CASE WHEN i = code THEN 1 ELSE 0 END for i in range(n)], '') AS bits FROM
  (SELECT article_id, coalesce(category, 'unknown') AS category FROM articles) JOIN (SELECT category, row_number() OVER (ORDER BY category) - 1 AS code, count(*) OVER () AS n
  FROM (SELECT DISTINCT coalesce(category, 'unknown') AS category FROM articles)) USING (category)""")
def _(spark, d):
    a = V.articles(spark, d)
    out = VO.one_hot_categories(a, VO.category_vocab(a))
    return out.select("article_id", F.array_join(F.transform("one_hot", lambda x: x.cast("int").cast("string")), "").alias("bits"))
