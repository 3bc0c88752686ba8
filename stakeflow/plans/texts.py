"""Text cleaning, hashing, parsing and report formatting."""

from pyspark.sql import functions as F

from stakeflow.functions import text as X
from stakeflow.functions.text import SPACE, WORD
from stakeflow.operators.sets import pivot_kv
from stakeflow.plans.registry import query

CLEAN = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(C, '[\x{{00}}-\x{{08}}\x{{0b}}\x{{0c}}\x{{0e}}-\x{{1f}}]', '', 'g'),
   '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?i)[{SPACE}]*on[{WORD}]+[{SPACE}]*=[{SPACE}]*["''][^"'']*["'']', '', 'g'), '(?i)javascript:', '', 'g'), '<[^>]+>', '', 'g')"""


@query("clean_text", "", f"""SELECT page_id, regexp_replace({CLEAN.replace('C,', 'html,')}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS text FROM pages""")
def _(t):
    return t.pages.select("page_id", X.clean_text(F.col("html")).alias("text"))


@query("clean_text_documents", "", f"""SELECT doc_id, md5(regexp_replace({CLEAN.replace('C,', 'text,')}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')) AS text_md5 FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("text_md5"))


SLUG = rf"""regexp_replace(substr(lower(regexp_replace(regexp_replace(regexp_replace(text, '[^{WORD}{SPACE}-]', '', 'g'), '[{SPACE}_]+', '-', 'g'), '-+', '-', 'g')), 1, 50), '^-+|-+$', '', 'g')"""


@query("slugify", "", f"SELECT doc_id, {SLUG} AS slug FROM documents")
def _(t):
    return t.documents.select("doc_id", X.slugify(F.col("text")).alias("slug"))


@query("truncate_words", "", """WITH h AS (SELECT doc_id, text, substr(text, 1, 117) AS h, strpos(reverse(substr(text, 1, 117)), ' ') AS b FROM documents)
  SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE concat(CASE WHEN b > 0 AND length(h) - b > 0 THEN substr(h, 1, length(h) - b) ELSE h END, '...') END AS short FROM h""")
def _(t):
    return t.documents.select("doc_id", X.truncate_words(F.col("text"), 120).alias("short"))


@query("row_hash", "", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def _(t):
    return t.documents.select("doc_id", *[X.row_hash(F.col("text"), a).alias(a) for a in ("md5", "sha1", "sha256")])


@query("query_params", "", r"""WITH q AS (SELECT page_id, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS p FROM pages WHERE contains(url, '?')),
   kv AS (SELECT page_id, url_decode(replace(split_part(p, '=', 1), '+', ' ')) AS key, url_decode(replace(regexp_extract(p, '=(.*)$', 1), '+', ' ')) AS value FROM q)
  SELECT page_id, key, string_agg(value, ',') AS "values" FROM kv WHERE value <> '' GROUP BY 1, 2""")
def _(t):
    return t.pages.select("page_id", F.explode(X.query_params(F.col("url")))).select(
        "page_id", "key", F.array_join("value", ",").alias("values"))


@query("to_utc", "", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 1 HOUR WHEN 2 THEN ts + INTERVAL 5 HOUR ELSE ts - INTERVAL 9 HOUR END AS utc FROM events""")
def _(t):
    k = F.col("event_id") % 4
    zone = F.when(k == 1, "Europe/Paris").when(k == 2, "America/New_York").when(k == 3, "Asia/Tokyo")
    return t.events.select("event_id", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.coalesce(zone, F.lit("UTC"))).cast("timestamp_ntz").alias("utc"))


@query("json_fields", "", """WITH e AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'broken{' ELSE props END AS props FROM events)
  SELECT event_id, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS k, 'none' AS missing, json_valid(props) AS valid FROM e""")
def _(t):
    props = F.when(F.col("event_id") % 10 == 0, "broken{").otherwise(F.col("props"))
    (k, _v), (missing, valid) = X.json_fields(props, {"k": "$.k"}), X.json_fields(props, {"missing": "$.a.b"}, "none")
    return t.events.select("event_id", k, missing, valid)


@query("report_columns", "v_bet", """SELECT bet_id, CASE sport WHEN 'football' THEN concat('$', format('{:,.2f}', stake * 100)) WHEN 'tennis' THEN concat('C$', format('{:,.2f}', stake * 100))
      WHEN 'esports' THEN concat(format('{:,.2f}', stake * 100), ' €') ELSE concat(format('{:,.2f}', stake * 100), ' ', 'SEK ') END AS amount,
    concat(format('{:.2f}', CASE WHEN stake / 200 <= 1 THEN stake / 200 * 100 ELSE stake / 200 END), '%') AS share,
    CASE WHEN bet_id >= 86400 THEN concat(bet_id // 86400, 'd', CASE WHEN bet_id % 86400 >= 3600 THEN concat(' ', bet_id % 86400 // 3600, 'h') WHEN bet_id % 3600 >= 60 THEN concat(' ', bet_id % 3600 // 60, 'm') WHEN bet_id % 60 > 0 THEN concat(' ', bet_id % 60, 's') ELSE '' END)
      WHEN bet_id >= 3600 THEN concat(bet_id // 3600, 'h', CASE WHEN bet_id % 3600 >= 60 THEN concat(' ', bet_id % 3600 // 60, 'm') WHEN bet_id % 60 > 0 THEN concat(' ', bet_id % 60, 's') ELSE '' END)
      WHEN bet_id >= 60 THEN concat(bet_id // 60, 'm', CASE WHEN bet_id % 60 > 0 THEN concat(' ', bet_id % 60, 's') ELSE '' END) ELSE concat(bet_id, 's') END AS duration,
    CASE WHEN stake * 2000 < 1000 THEN concat(format('{:.2f}', stake * 2000), ' B') WHEN stake * 2000 < 1000000 THEN concat(format('{:.2f}', stake * 2000 / 1000), ' KB') ELSE concat(format('{:.2f}', stake * 2000 / 1000000), ' MB') END AS size
   FROM v_bet""")
def _(t):
    code = F.when(F.col("sport") == "football", "USD").when(F.col("sport") == "tennis", "cad").when(F.col("sport") == "esports", "EUR").otherwise("SEK")
    return t.bet.select(
        "bet_id", X.currency_text(F.col("stake") * 100, code).alias("amount"), X.percent_text(F.col("stake") / 200).alias("share"),
        X.duration_text(F.col("bet_id")).alias("duration"), X.size_text(F.col("stake") * 2000).alias("size"))


@query("parse_flags_sizes", "v_bet", """SELECT bet_id, CASE WHEN bet_id % 5 IN (0, 1) THEN TRUE ELSE FALSE END AS flag,
    CASE bet_id % 3 WHEN 0 THEN CAST(floor(CAST(odds AS DOUBLE) * 1048576) AS BIGINT) WHEN 1 THEN CAST(floor(CAST(odds AS DOUBLE) * 1024) AS BIGINT) END AS bytes FROM v_bet""")
def _(t):
    k = F.col("bet_id") % 5
    flag = F.when(k == 0, " Yes").when(k == 1, "T").when(k == 2, "off").when(k == 3, "maybe")
    size = F.concat(F.col("odds").cast("string"), F.when(F.col("bet_id") % 3 == 0, " mb").when(F.col("bet_id") % 3 == 1, "KB").otherwise(" parsecs"))
    return t.bet.select("bet_id", X.parse_flag(flag).alias("flag"), X.parse_size(size).alias("bytes"))


@query("pivot_kv", "", """WITH l AS (SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
  SELECT user_id, count(*) AS keys, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'purchase') AS purchase FROM l GROUP BY 1""")
def _(t):
    return pivot_kv(t.events, ["user_id"], "event_type", "value", ["ts", "event_id"], ["click", "purchase"])
