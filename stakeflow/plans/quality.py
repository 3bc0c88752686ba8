"""Rule scans, validation, outliers and scaling."""

from pyspark.sql import functions as F

from stakeflow.functions import text as X
from stakeflow.functions.rules import IPV4, IPV6
from stakeflow.functions.text import SPACE, WORD
from stakeflow.operators import quality as Q
from stakeflow.operators.scan import time_block
from stakeflow.plans.registry import query

# contact records derived from customers, with a share of malformed values in each column
CONTACTS = """SELECT c_custkey AS id,
  CASE WHEN c_custkey % 7 = 0 THEN concat(lower(c_mktsegment), '@nowhere') WHEN c_custkey % 11 = 0 THEN concat('.', lower(c_mktsegment), '@example.com')
       WHEN c_custkey % 13 <> 0 THEN concat(lower(c_mktsegment), '.', CAST(c_custkey AS VARCHAR(20)), '@mail.example.com') END AS email,
  CASE c_custkey % 4 WHEN 0 THEN concat('+33 6 12 34 ', CAST(10 + c_custkey % 90 AS VARCHAR(20)), ' 78') WHEN 1 THEN concat('(555) 010-', CAST(1000 + c_custkey % 9000 AS VARCHAR(20)))
       WHEN 2 THEN 'n/a' ELSE CAST(c_custkey AS VARCHAR(20)) END AS phone,
  CASE c_custkey % 3 WHEN 0 THEN concat('10.', CAST(c_custkey % 300 AS VARCHAR(20)), '.0.1') WHEN 1 THEN concat('2001:db8::', CAST(c_custkey % 9999 AS VARCHAR(20))) ELSE '1.2.3' END AS ip,
  CASE c_custkey % 3 WHEN 0 THEN concat('199', CAST(c_custkey % 10 AS VARCHAR(20)), '-2-', CAST(1 + c_custkey % 31 AS VARCHAR(20))) WHEN 1 THEN '2024-12-05' ELSE 'tomorrow' END AS day,
  CASE WHEN c_custkey % 5 = 0 THEN md5(c_name) ELSE c_name END AS uid,
  concat(substr(concat('0000', CAST(c_custkey AS VARCHAR(20))), -5, 5), CASE WHEN c_custkey % 2 = 0 THEN '-1234' ELSE '' END) AS zip,
  CASE WHEN c_custkey % 6 = 0 THEN c_name WHEN c_custkey % 6 = 1 THEN concat('u_', CAST(c_custkey AS VARCHAR(20))) ELSE concat('_', c_mktsegment, '__x') END AS username,
  CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE c_mktsegment END AS segment, c_acctbal AS balance FROM {customer}"""

RULES = {
    "email": "email", "phone": ["phone", ("phone", "FR")], "ip": "ip", "day": "date", "uid": "uuid", "zip": "postal_code",
    "username": "username", "segment": ["not_empty", ("length", 2, 9)], "balance": ("range", 0.0, 5000.0),
}
CHECKS = [
    ("email:email", r"regexp_full_match(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') AND NOT starts_with(email, '.') AND NOT contains(split_part(email, '@', 1), '..') AND NOT ends_with(split_part(email, '@', 1), '.')"),
    ("phone:phone", r"regexp_full_match(regexp_replace(phone, '[\s\-\(\)\.]', '', 'g'), '\+?[0-9]{7,15}')"),
    ("phone:phone2", r"regexp_full_match(regexp_replace(phone, '[\s\-\(\)\.]', '', 'g'), '(\+33|0)[0-9]{9}')"),
    ("ip:ip", f"regexp_matches(ip, '^{IPV4}$') OR regexp_matches(ip, '{IPV6}')"),
    ("day:date", r"regexp_matches(day, '^\d{4}-\d{1,2}-\d{1,2}$') AND try_strptime(day, '%Y-%m-%d') IS NOT NULL"),
    ("uid:uuid", "regexp_matches(uid, '^[0-9a-fA-F]{32}$')"),
    ("zip:postal_code", r"regexp_matches(zip, '^\d{5}(-\d{4})?$')"),
    ("username:username", "length(username) BETWEEN 3 AND 30 AND regexp_matches(username, '^[a-zA-Z0-9_]+$') AND NOT regexp_matches(username, '^[._-]|[._-]$|[._-]{2,}')"),
    ("segment:not_empty", "trim(segment) <> ''"), ("segment:length", "length(segment) BETWEEN 2 AND 9"), ("balance:range", "balance BETWEEN 0 AND 5000"),
]


@query("dq_rules", "", f"WITH c AS ({CONTACTS.replace('{customer}', 'customer')}) " + " UNION ALL ".join(
    f"SELECT '{n.rstrip('2')}' AS rule, count(*) FILTER (COALESCE({c}, FALSE)) AS passed, count(*) FILTER (NOT COALESCE({c}, FALSE)) AS failed FROM c" for n, c in CHECKS))
def _(t):
    return Q.dq_rules(t.spark.sql(CONTACTS, customer=t.customer), RULES)


@query("dq_rules_pages", "", r"""SELECT 'url:url' AS rule, count(*) FILTER (regexp_matches(url, '^(?i)(https?)://[^\s/$.?#].[^\s]*$')) AS passed,
    count(*) FILTER (NOT regexp_matches(url, '^(?i)(https?)://[^\s/$.?#].[^\s]*$')) AS failed FROM pages
   UNION ALL SELECT 'html:length', count(*) FILTER (length(html) BETWEEN 1000 AND 4000), count(*) FILTER (NOT length(html) BETWEEN 1000 AND 4000) FROM pages
   UNION ALL SELECT 'html:json', count(*) FILTER (json_valid(html)), count(*) FILTER (NOT json_valid(html)) FROM pages""")
def _(t):
    return Q.dq_rules(t.pages, {"url": "url", "html": [("length", 1000, 4000), "json"]})


LUHN = """list_sum(list_transform(range(1, length(x) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(x), i, 1) AS INT) WHEN CAST(substr(reverse(x), i, 1) AS INT) > 4 THEN CAST(substr(reverse(x), i, 1) AS INT) * 2 - 9
       ELSE CAST(substr(reverse(x), i, 1) AS INT) * 2 END)) % 10 = 0"""
PII = rf"""WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '{X.EMAIL_CANDIDATE}')) AS emails,
     len(list_filter(list_transform(regexp_extract_all(regexp_replace(text, '{X.CARD_GROUPS}', '_', 'g'), '{X.PHONE_CANDIDATE}'), lambda x: regexp_replace(x, '[\s\-\(\)\.]', '', 'g')),
        lambda x: regexp_matches(x, '^\+?[0-9]{{7,15}}$'))) AS phones,
     list_filter(list_transform(regexp_extract_all(text, '{X.CARD_CANDIDATE}'), lambda x: regexp_replace(x, '[ -]', '', 'g')), lambda x: length(x) BETWEEN 13 AND 19) AS cand FROM documents),
   m AS (SELECT doc_id, emails, phones, list_transform(cand, lambda x: CASE WHEN length(x) = 19 AND NOT ({LUHN}) THEN substr(x, 1, 16) ELSE x END) AS cand FROM d),
   k AS (SELECT doc_id, emails, phones, list_filter(cand, lambda x: {LUHN}) AS c FROM m)
  SELECT doc_id, emails, phones, len(c) AS cards, len(list_filter(c, lambda x: regexp_matches(x, '^4'))) AS visa, len(list_filter(c, lambda x: regexp_matches(x, '^5[1-5]'))) AS mastercard,
    len(list_filter(c, lambda x: regexp_matches(x, '^3[47]'))) AS amex, len(list_filter(c, lambda x: regexp_matches(x, '^6011'))) AS discover FROM k"""


@query("pii_scan", "", PII)
def _(t):
    return Q.pii_scan(t.documents.select("doc_id", "text"))


_W = WORD
ATTACK = rf"""SELECT {{id}}, regexp_matches({{text}}, '(?i)(^|[^{_W}])(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC|EXECUTE)($|[^{_W}])') AS sql_keyword,
   regexp_matches({{text}}, '(--|#|/\*|\*/)') AS sql_comment, regexp_matches({{text}}, '(?i)(^|[^{_W}])OR(=|[^{_W}\n][^\n]*=)') AS sql_or,
   regexp_matches({{text}}, '(?i)(^|[^{_W}])AND(=|[^{_W}\n][^\n]*=)') AS sql_and, regexp_matches({{text}}, '(''|--|;|\||&)') AS sql_meta,
   regexp_matches({{text}}, '(?i)<script[^>]*>[^\n]*?</script>') AS xss_script, regexp_matches({{text}}, '(?i)javascript:') AS xss_javascript,
   regexp_matches({{text}}, '(?i)on[{_W}]+[\s\x{{{{0b}}}}\x{{{{1c}}}}-\x{{{{1f}}}}\x{{{{85}}}}\p{{{{Z}}}}]*=') AS xss_handler, regexp_matches({{text}}, '(?i)<iframe') AS xss_iframe,
   regexp_matches({{text}}, '(?i)<object') AS xss_object, regexp_matches({{text}}, '(?i)<embed') AS xss_embed FROM {{table}}"""


def _attack_sql(id_, text, table):
    q = ATTACK.replace("{{", "{").replace("}}", "}").replace("{id}", id_).replace("{text}", text).replace("{table}", table)
    return f"WITH f AS ({q}) SELECT *, sql_keyword OR sql_comment OR sql_or OR sql_and OR sql_meta AS sql_injection, xss_script OR xss_javascript OR xss_handler OR xss_iframe OR xss_object OR xss_embed AS xss FROM f"


@query("attack_scan", "", _attack_sql("doc_id", "text", "documents"))
def _(t):
    return Q.attack_scan(t.documents.select("doc_id", "text"), "text")


@query("attack_scan_pages", "", _attack_sql("page_id", "html", "pages"))
def _(t):
    return Q.attack_scan(t.pages.select("page_id", "html"), "html")


@query("schema_conformance", "", """SELECT 'k' AS path, count(*) FILTER (json_extract(props, '$.k') IS NULL) AS missing,
    count(*) FILTER (json_extract(props, '$.k') IS NOT NULL AND json_type(props, '$.k') NOT IN ('BIGINT', 'UBIGINT')) AS wrong_type, count(*) AS rows FROM events
   UNION ALL SELECT 'a.b', count(*) FILTER (json_extract(props, '$.a.b') IS NULL), 0, count(*) FROM events""")
def _(t):
    return Q.schema_conformance(t.events, "props", {"k": "BIGINT", "a.b": "STRING"})


def _requests(t):
    return t.bet.select(
        "bet_id", "bet_type", "stake", "odds", (F.col("stake") / 2).alias("confidence"), (F.col("bet_id") % 25).alias("legs"),
        (F.col("bet_id") % 5 == 0).alias("partial"), F.when(F.col("bet_id") % 10 == 0, F.col("stake")).alias("partial_amount"))


DOMAIN = """r AS (SELECT bet_id, COALESCE(NOT stake BETWEEN 1 AND 10000, FALSE) AS stake_range, COALESCE(NOT odds BETWEEN 1.01 AND 1000, FALSE) AS odds_range,
   COALESCE(NOT stake / 2 BETWEEN 0 AND 100, FALSE) AS confidence_range, bet_type <> 'single' AND NOT bet_id % 25 BETWEEN 2 AND 20 AS legs_count,
   (bet_id % 5 = 0) <> (bet_id % 10 = 0) AS partial_cashout FROM v_bet)"""
BET_RULES = ("stake_range", "odds_range", "confidence_range", "legs_count", "partial_cashout")


@query("domain_checks", "v_bet", f"WITH {DOMAIN} " + " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER ({r}) AS violations FROM r" for r in BET_RULES))
def _(t):
    return Q.domain_checks(_requests(t), Q.bet_domain_rules())


@query("domain_rejects", "v_bet", f"""WITH {DOMAIN}, b AS (SELECT bet_id, concat_ws(',', {', '.join(f"CASE WHEN {r} THEN '{r}' END" for r in BET_RULES)}) AS broken FROM r)
   SELECT * FROM b WHERE broken <> ''""")
def _(t):
    return Q.domain_rejects(_requests(t), Q.bet_domain_rules()).select("bet_id", "broken")


@query("domain_checks_sport", "", """WITH r AS (SELECT NOT 1790 + p_partkey % 250 BETWEEN 1800 AND 2030 AS a, NOT p_size BETWEEN 15 AND 50 AS b, NOT p_retailprice / 10 BETWEEN 0 AND 100 AS c FROM part)
   SELECT 'founded_range' AS rule, count(*) FILTER (a) AS violations FROM r UNION ALL SELECT 'age_range', count(*) FILTER (b) FROM r UNION ALL SELECT 'humidity_range', count(*) FILTER (c) FROM r""")
def _(t):
    d = t.part.select((F.col("p_partkey") % 250 + 1790).alias("founded"), F.col("p_size").alias("age"), (F.col("p_retailprice") / 10).alias("humidity"))
    return Q.domain_checks(d, Q.sport_domain_rules())


@query("not_null", "v_bet", """SELECT 'stake' AS "column", count(*) FILTER (stake IS NULL) AS nulls FROM v_bet UNION ALL SELECT 'cashout_value', count(*) FILTER (cashout_value IS NULL) FROM v_bet""")
def _(t):
    return Q.not_null(t.bet, ["stake", "cashout_value"])


@query("unique_key", "", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return Q.unique_key(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("accepted_values", "v_bet", "SELECT status, count(*) AS rows FROM v_bet WHERE status NOT IN ('won', 'lost', 'void') GROUP BY 1")
def _(t):
    return Q.accepted_values(t.bet, "status", ("won", "lost", "void"))


@query("outliers_z", "", """WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1)
  SELECT event_id, event_type, value, round(m - 3 * sd, 6) AS low, round(m + 3 * sd, 6) AS high FROM events JOIN s USING (event_type) WHERE value < round(m - 3 * sd, 6) OR value > round(m + 3 * sd, 6)""")
def _(t):
    return Q.outliers(t.events.select("event_id", "event_type", "value"), ["event_type"], "value", "z")


@query("outliers_iqr", "", """WITH s AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem GROUP BY 1),
   f AS (SELECT l_returnflag, round(a - 0.5 * (b - a), 6) AS low, round(b + 0.5 * (b - a), 6) AS high FROM s)
  SELECT l_orderkey, l_partkey, l_returnflag, l_extendedprice, low, high FROM lineitem JOIN f USING (l_returnflag) WHERE l_extendedprice < low OR l_extendedprice > high""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag", "l_extendedprice")
    return Q.outliers(d, ["l_returnflag"], "l_extendedprice", "iqr", k=0.5)


@query("metric_anomalies", "", """WITH w AS (SELECT event_id, user_id, value, avg(value) OVER f AS m, stddev_samp(value) OVER f AS sd, count(*) OVER f AS n FROM events
     WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), z AS (SELECT event_id, user_id, value, round((value - m) / nullif(sd, 0), 6) AS z FROM w WHERE n = 20)
  SELECT * FROM z WHERE abs(z) > 3""")
def _(t):
    e = t.events.select("event_id", "user_id", "ts", "value")
    return Q.metric_anomalies(e, ["user_id"], ["ts", "event_id"], time_block("ts"), "value", 20, 3.0).select("event_id", "user_id", "value", "z")


def _report(c):
    return f"""SELECT '{c}' AS "column", round(CAST(count({c}) AS DOUBLE) / count(*), 6) AS completeness, count(DISTINCT {c}) AS distinct_values,
      round(CAST(count(DISTINCT {c}) AS DOUBLE) / count({c}), 6) AS distinctness, max(placed_at) AS newest FROM v_bet"""


@query("quality_report", "v_bet", " UNION ALL ".join(_report(c) for c in ("user_id", "market", "stake", "cashout_value")))
def _(t):
    return Q.quality_report(t.bet, ["user_id", "market", "stake", "cashout_value"], "placed_at", exact=True)


@query("normalize_minmax", "", """SELECT event_id, event_type, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)""")
def _(t):
    return Q.normalize(t.events.select("event_id", "event_type", "value"), ["event_type"], "value", "minmax").drop("value")


@query("normalize_zscore", "", """SELECT event_id, event_type, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)""")
def _(t):
    return Q.normalize(t.events.select("event_id", "event_type", "value"), ["event_type"], "value", "zscore").drop("value")


# lexicon of the invented prose
LEXICON = {"the": 0.2, "and": 0.1, "thanks": 1.0, "on": -0.1, "in": -0.2, "was": -0.5, "les": 0.3, "une": 0.4, "der": -0.3, "que": -0.4}
LEX_SQL = "(VALUES " + ", ".join(f"('{w}', {s})" for w, s in LEXICON.items()) + ") l(w, s)"


@query("text_sentiment_trend", "", rf"""WITH w AS (SELECT doc_id, source, CAST(doc_id % 30 AS INT) AS k, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) AS w FROM documents),
   h AS (SELECT doc_id, count(*) AS n, avg(CAST(s AS DOUBLE)) AS score FROM w JOIN {LEX_SQL} USING (w) GROUP BY 1)
  SELECT source, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS day, count(*) AS documents, CAST(sum(COALESCE(n, 0)) AS BIGINT) AS hits, round(avg(COALESCE(score, 0)), 6) AS mean_score
  FROM documents LEFT JOIN h USING (doc_id) GROUP BY 1, 2""")
def _(t):
    docs = t.documents.select("source", "text", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("day"))
    return Q.sentiment_trend(docs, LEXICON)
