"""Queries of findings, frames and traces; line items stand in for findings and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import findings as N, frames as C, retrieval as R
from strandloom.plans.retrieval import _ASKED, searches
from strandloom.session import table

RULES = [("todo", "open point|Open point", "low"), ("fault", "fault handler|frame", "high"), ("leak", "leaks a secret|expired credential", "critical"), ("hash", "0x[0-9A-F]{5}", "info")]
AGAINST = [("ships", "keeps"), ("forgets", "returns")]


def _findings(spark, d):
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity")
    severity = F.when(q > 48, "critical").when(q > 40, "high").when(q > 25, "medium").when(q > 10, "low").otherwise("info")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("file"), F.concat("l_returnflag", "l_linestatus").alias("rule"), F.col("l_linenumber").cast("bigint").alias("line"), severity.alias("severity"), F.round(F.col("l_discount") * 10, 2).alias("confidence"), F.col("l_partkey").alias("part"))


def findings_stats(spark, d):
    return N.severity_pivot(_findings(spark, d), ["rule"], "severity", fold_info=True)


def findings_by_file(spark, d):
    return N.severity_pivot(_findings(spark, d), ["file"], "severity")


def findings_collected(spark, d):
    """Ids by severity and file, in order; a file's list is as long as its findings of a severity on one line."""
    f = _findings(spark, d)
    return f.groupBy("file", "severity", "line").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("rules"))


def findings_order(spark, d):
    f = _findings(spark, d).withColumn("w", N.severity_weight(F.col("severity")))
    return f.select("id", F.row_number().over(R.W.partitionBy("file").orderBy(F.desc("w"), F.desc("confidence"), "line", "id")).cast("bigint").alias("place"))


def findings_top(spark, d):
    f = _findings(spark, d).filter("severity IN ('critical', 'high') AND confidence >= 0.7").withColumn("w", N.severity_weight(F.col("severity")))
    return f.orderBy(F.desc("w"), F.desc("confidence"), "line", "id").limit(10).select("id", "severity", "confidence", "line")


def findings_limit_first(spark, d):
    """The first five of a file in input order."""
    return N.limited_per(_findings(spark, d), "file", [F.asc("id")], 5).select("file", "id")


def findings_sort_limit(spark, d):
    """The five most severe of a file."""
    return N.limited_per(_findings(spark, d), "file", [F.desc(N.severity_weight(F.col("severity"))), F.asc("id")], 5).select("file", "id")


def findings_dedup(spark, d):
    """First by id of each rule, file and line."""
    return N.first_of(_findings(spark, d), ["rule", "file", "line"], [F.asc("id")]).select("rule", "file", "line", "id")


def findings_dedup_confident(spark, d):
    return N.first_of(_findings(spark, d), ["rule", "file", "line"], [F.desc("confidence"), F.asc("id")]).select("rule", "file", "line", "id", "confidence")


def findings_merge(spark, d):
    """Two sources joined, one row per place, in order of file, line and severity."""
    f = _findings(spark, d)
    both = f.filter("id % 2 = 0").withColumn("src", F.lit(1)).unionByName(f.filter("id % 3 = 0").withColumn("src", F.lit(2)))
    return N.first_of(both, ["file", "line"], [F.desc("confidence"), F.asc("src"), F.asc("id")]).select("file", "line", "id", "src")


def finding_diff(spark, d):
    f = _findings(spark, d)
    return N.multiset_diff(f.filter("id % 3 <> 0"), f.filter("id % 4 <> 0"), ["rule", "file"])


def bug_groups(spark, d):
    return N.grouped(_findings(spark, d), ["part", "rule", "severity"], "id", "severity", "confidence")


def bug_priority(spark, d):
    f = _findings(spark, d)
    kind = F.when(F.col("rule") == "RF", 1.0).when(F.col("rule") == "AF", 0.7).otherwise(0.4)
    n = f.groupBy("part", "rule").agg(F.count("*").alias("n"), F.countDistinct("file").alias("boards"), F.max(N.severity_weight(F.col("severity"))).alias("w"), F.max("confidence").alias("c"))
    p = F.least(0.35 * F.col("w") + 0.25 * kind + F.least(F.lit(0.2), 0.05 * F.col("n")) + F.least(F.lit(0.15), 0.05 * F.col("boards")) + 0.15 * F.col("c"), F.lit(1.0))
    return n.select("part", "rule", F.round(p, 6).alias("priority"))


def fix_order(spark, d):
    """Five sort keys: confidence, risk, automation, review, id."""
    f = _findings(spark, d)
    return f.select("id", F.row_number().over(R.W.partitionBy("part").orderBy(F.desc("confidence"), "severity", F.desc(F.col("id") % 2), F.col("id") % 3, "id")).cast("bigint").alias("place"))


def grep(spark, d):
    return N.grep(table(spark, d, "documents"), "doc_id", "text", "0x[0-9A-F]{5}").select("doc_id", "line", "column", F.sha2("content", 256).alias("digest"))


def rule_findings(spark, d):
    return N.apply_rules(table(spark, d, "documents"), "doc_id", "text", RULES)


def rule_conflicts(spark, d):
    """Review titles of the same pull request set against each other."""
    s = table(spark, d, "sessions").filter("pr_id IS NOT NULL").select("pr_id", "title").distinct()
    other = s.withColumnRenamed("title", "other")
    pairs = s.join(other, "pr_id").filter("title < other")
    return pairs.select("pr_id", "title", "other", N.conflict_kind(F.col("title"), F.col("other"), [("Draft", "Fix"), ("Review", "Follow")], 0.4).alias("kind")).filter("kind IS NOT NULL")


def schema_score(spark, d):
    """One point a query term, four for a register word, three for a driver word and a half for a page; the keywords of each
    document whose id is divisible by 20 against all others."""
    low = F.lower(F.coalesce("text", F.lit("")))
    bonus = F.when(low.contains("register"), 4.0).otherwise(0.0) + F.when(low.contains("driver"), 3.0).otherwise(0.0) + F.when(F.col("doc_type") == "page", 0.5).otherwise(0.0)
    rows = R.term_score(table(spark, d, "documents"), searches(spark, d), k=21, weight=1.0, bonus=bonus).filter("doc_id <> query_id").drop("rank")
    return R.top_per(rows, "query_id", [F.desc("score"), F.asc("doc_id")], 20)


def close_names(spark, d):
    """Nations whose names lie at most three edits apart (a table of fixed size)."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    other = n.select(F.col("n_nationkey").alias("other_key"), F.col("n_name").alias("other_name"))
    far = F.levenshtein("n_name", "other_name")
    return n.join(R.small(other), far <= 3).filter("n_nationkey < other_key").select("n_nationkey", "other_key", far.cast("bigint").alias("edits"))


def bit_decode(spark, d):
    e = table(spark, d, "events").withColumn("can_id", (F.col("event_id") * 2654435761) % 536870912)
    return e.select("event_id", *(c.cast("bigint").alias(n) for n, c in C.j1939(F.col("can_id"), F.col("user_id") % 9).items()))


def canopen_decode(spark, d):
    e = table(spark, d, "events").withColumns({"can_id": F.col("event_id") % 2048, "data": F.unhex(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8))})
    return e.select("event_id", *(c.cast("bigint").alias(n) for n, c in C.canopen(F.col("can_id"), F.col("data")).items()))


def register_fields(spark, d):
    return table(spark, d, "events").select("event_id", *(C.register_field(F.col("event_id"), o, w).alias(f"f{o}_{w}") for o, w in ((0, 4), (4, 3), (7, 9))))


def frame_stats(spark, d):
    e = table(spark, d, "events")
    return e.agg(F.count("*").alias("frames"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_id") % 2 == 0).alias("extended"), F.countDistinct("user_id").alias("ids"))


def pgn_shares(spark, d):
    e = table(spark, d, "events").withColumn("can_id", (F.col("event_id") * 2654435761) % 536870912)
    return C.group_shares(e, [(C.register_field(F.col("can_id"), 8, 6)).alias("pgn")])


def frame_filter(spark, d):
    """Extended frames in a range of ids, the last 100 in order."""
    e = table(spark, d, "events").filter("event_id % 2 = 0 AND user_id BETWEEN 5 AND 60")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id")


def log_parse(spark, d):
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("raw "), "event_type")).otherwise(F.concat(F.lit("["), "event_id", F.lit("] ["), F.upper("event_type"), F.lit("] [u"), "user_id", F.lit("] value "), "event_id"))
    return e.withColumn("l", line).select("event_id", *(c.alias(n) for n, c in C.parse_log(F.col("l")).items()))


def herrings(spark, d):
    """Root-cause scores of the events before each user's errors."""
    from strandloom.plans.logs import causal, trace_corr

    near = trace_corr(spark, d)
    rows = causal(spark, d).join(near, "event_id").join(table(spark, d, "events").select("event_id", "event_type"), "event_id")
    score = F.least(F.col("score") * F.when(F.col("event_type") == "view", 0.5).otherwise(1.0) + F.when(F.col("n_near") > 0, 0.3).otherwise(0.0), F.lit(1.0))
    return rows.select("event_id", "symptom_id", F.round(score, 6).alias("cause_score"))


def symptom_hypotheses(spark, d):
    x = table(spark, d, "experience").select("exp_id", "last_error", "response_preview").distinct()
    h = C.hypotheses(F.coalesce("last_error", F.lit("")), [("overflow", "overflow"), ("desync", "timing"), ("refusal of", "memory")], F.coalesce("response_preview", F.lit("")))
    return x.select("exp_id", F.explode(h).alias("h")).groupBy("exp_id", "h.cause").agg(F.round(F.max("h.score"), 6).alias("score"))


QUERIES = {f.__name__: f for f in (findings_stats, findings_by_file, findings_collected, findings_order, findings_top, findings_limit_first, findings_sort_limit, findings_dedup, findings_dedup_confident, findings_merge, finding_diff, bug_groups, bug_priority, fix_order, grep, rule_findings, rule_conflicts, schema_score, close_names, bit_decode, canopen_decode, register_fields, frame_stats, pgn_shares, frame_filter, log_parse, herrings, symptom_hypotheses)}

_F = """f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS file, l_returnflag || l_linestatus AS rule, l_linenumber::BIGINT AS line,
CASE WHEN l_quantity > 48 THEN 'critical' WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 25 THEN 'medium' WHEN l_quantity > 10 THEN 'low' ELSE 'info' END AS severity,
CASE WHEN l_quantity > 48 THEN 1.0::DOUBLE WHEN l_quantity > 40 THEN 0.8 WHEN l_quantity > 25 THEN 0.5 WHEN l_quantity > 10 THEN 0.3 ELSE 0.1 END AS w, round(l_discount * 10, 2) AS confidence, l_partkey AS part FROM lineitem)"""
_SEV = ("critical", "high", "medium", "low", "info")
_FIRST = "WITH {f} SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM {src}) WHERE n <= {n}"
_LINES = "lines AS (SELECT doc_id, content, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE text IS NOT NULL))"
SQL = {
    "findings_stats": f"WITH {_F} SELECT rule, count(*) AS total, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in _SEV[:3]) + ", count(*) FILTER (severity IN ('low', 'info')) AS low, 0::BIGINT AS info FROM f GROUP BY rule",
    "findings_by_file": f"WITH {_F} SELECT file, count(*) AS total, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in _SEV) + " FROM f GROUP BY file",
    "findings_collected": f"WITH {_F} SELECT file, severity, line, count(*) AS n, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM f GROUP BY 1, 2, 3",
    "findings_order": f"WITH {_F} SELECT id, row_number() OVER (PARTITION BY file ORDER BY w DESC, confidence DESC, line, id) AS place FROM f",
    "findings_top": f"WITH {_F} SELECT id, severity, confidence, line FROM f WHERE severity IN ('critical', 'high') AND confidence >= 0.7 ORDER BY w DESC, confidence DESC, line, id LIMIT 10",
    "findings_limit_first": _FIRST.format(f=_F, cols="file, id", keys="file", order="id", src="f", n=5),
    "findings_sort_limit": _FIRST.format(f=_F, cols="file, id", keys="file", order="w DESC, id", src="f", n=5),
    "findings_dedup": _FIRST.format(f=_F, cols="rule, file, line, id", keys="rule, file, line", order="id", src="f", n=1),
    "findings_dedup_confident": _FIRST.format(f=_F, cols="rule, file, line, id, confidence", keys="rule, file, line", order="confidence DESC, id", src="f", n=1),
    "findings_merge": _FIRST.format(f=_F + ", u AS (SELECT *, 1 AS src FROM f WHERE id % 2 = 0 UNION ALL SELECT *, 2 FROM f WHERE id % 3 = 0)", cols="file, line, id, src", keys="file, line", order="confidence DESC, src, id", src="u", n=1),
    "finding_diff": f"""WITH {_F}, c AS (SELECT rule, file, count(*) FILTER (id % 3 <> 0) AS b, count(*) FILTER (id % 4 <> 0) AS a FROM f GROUP BY 1, 2)
SELECT rule, file, greatest(b - a, 0) AS resolved, least(a, b) AS remaining, greatest(a - b, 0) AS regressed FROM c WHERE a > 0 OR b > 0""",
    "bug_groups": f"WITH {_F} SELECT sha256(part || ':' || rule || ':' || severity) AS group_key, count(*) AS n, min(id) AS first_seen, max(id) AS last_seen, arg_min(id, (-w, -confidence, id)) AS representative FROM f GROUP BY part, rule, severity",
    "bug_priority": f"""WITH {_F}, n AS (SELECT part, rule, count(*) AS n, count(DISTINCT file) AS boards, max(w) AS w, max(confidence) AS c FROM f GROUP BY 1, 2)
SELECT part, rule, round(least(0.35::DOUBLE * w + 0.25::DOUBLE * CASE rule WHEN 'RF' THEN 1.0::DOUBLE WHEN 'AF' THEN 0.7 ELSE 0.4 END + least(0.2::DOUBLE, 0.05::DOUBLE * n) + least(0.15::DOUBLE, 0.05::DOUBLE * boards) + 0.15::DOUBLE * c, 1.0), 6) AS priority FROM n""",
    "fix_order": f"WITH {_F} SELECT id, row_number() OVER (PARTITION BY part ORDER BY confidence DESC, severity, id % 2 DESC, id % 3, id) AS place FROM f",
    "grep": f"WITH {_LINES} SELECT doc_id, line, length(regexp_extract(content, '^(.*?)0x[0-9A-F]{{5}}', 1)) + 1 AS \"column\", sha256(content) AS digest FROM lines WHERE regexp_matches(content, '0x[0-9A-F]{{5}}')",
    "rule_findings": f"WITH {_LINES}, r AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{p}', '{s}')" for n, p, s in RULES) + ") t(rule, pattern, severity)) SELECT doc_id, rule, severity, line FROM lines, r WHERE regexp_matches(content, pattern)",
    "close_names": "SELECT a.n_nationkey, b.n_nationkey AS other_key, levenshtein(a.n_name, b.n_name) AS edits FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE levenshtein(a.n_name, b.n_name) <= 3",
    "bit_decode": "SELECT event_id, " + ", ".join(f"CASE WHEN user_id % 9 >= 3 THEN (id >> {o}) & {m} END AS {n}" for n, o, m in (("pgn", 8, 0x3FFFF), ("priority", 26, 7), ("source", 0, 255), ("destination", 8, 255))) + " FROM (SELECT *, (event_id * 2654435761) % 536870912 AS id FROM events)",
    "canopen_decode": "SELECT event_id, event_id % 2048 & 127 AS node, event_id % 2048 >> 7 AS function, ('0x' || left(md5(event_id::VARCHAR), 2))::BIGINT AS command FROM events",
    "rule_conflicts": """WITH s AS (SELECT DISTINCT pr_id, title, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS w FROM sessions WHERE pr_id IS NOT NULL AND title IS NOT NULL),
p AS (SELECT a.pr_id, a.title, b.title AS other, len(list_intersect(a.w, b.w)) AS n, len(a.w) + len(b.w) AS m FROM s a JOIN s b ON a.pr_id = b.pr_id AND a.title < b.title)
SELECT * FROM (SELECT pr_id, title, other, CASE WHEN (contains(title, 'Draft') AND contains(other, 'Fix')) OR (contains(title, 'Fix') AND contains(other, 'Draft')) OR (contains(title, 'Review') AND contains(other, 'Follow')) OR (contains(title, 'Follow') AND contains(other, 'Review')) THEN 'contradiction'
WHEN n / greatest(m - n, 1) > 0.4 THEN 'overlap' END AS kind FROM p) WHERE kind IS NOT NULL""",
    "register_fields": "SELECT event_id, " + ", ".join(f"(event_id >> {o}) & {(1 << w) - 1} AS f{o}_{w}" for o, w in ((0, 4), (4, 3), (7, 9))) + " FROM events",
    "frame_stats": "SELECT count(*) AS frames, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_id % 2 = 0) AS extended, count(DISTINCT user_id) AS ids FROM events",
    "pgn_shares": "SELECT (((event_id * 2654435761) % 536870912) >> 8) & 63 AS pgn, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1",
    "frame_filter": "SELECT event_id, user_id FROM events WHERE event_id % 2 = 0 AND user_id BETWEEN 5 AND 60 ORDER BY ts DESC, event_id DESC LIMIT 100",
    "log_parse": "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_id::VARCHAR END AS time, CASE WHEN event_id % 5 > 0 THEN upper(event_type) ELSE 'INFO' END AS level, CASE WHEN event_id % 5 > 0 THEN 'u' || user_id ELSE 'unknown' END AS source, CASE WHEN event_id % 5 > 0 THEN 'value ' || event_id ELSE 'raw ' || event_type END AS message FROM events",
    "schema_score": f"""WITH {_ASKED}, terms AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(query, '[a-z0-9_]+'))) AS t FROM asked),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS low, CASE WHEN contains(lower(coalesce(text, '')), 'register') THEN 4 ELSE 0 END + CASE WHEN contains(lower(coalesce(text, '')), 'driver') THEN 3 ELSE 0 END + CASE WHEN doc_type = 'page' THEN 0.5::DOUBLE ELSE 0 END AS bonus FROM documents),
holds AS (SELECT doc_id, t FROM d, (SELECT DISTINCT t FROM terms) WHERE contains(low, t)), n AS (SELECT query_id, doc_id, count(*) AS n FROM holds JOIN terms USING (t) GROUP BY 1, 2),
s AS (SELECT q.query_id, d.doc_id, bonus + coalesce(n.n, 0) AS score FROM (SELECT DISTINCT query_id FROM asked) q JOIN d ON d.doc_id <> q.query_id LEFT JOIN n ON n.query_id = q.query_id AND n.doc_id = d.doc_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
    "symptom_hypotheses": """WITH x AS (SELECT DISTINCT exp_id, coalesce(last_error, '') AS e, lower(coalesce(response_preview, '')) AS c FROM experience), p AS (SELECT * FROM (VALUES ('overflow', 'overflow'), ('desync', 'timing'), ('refusal of', 'memory')) t(pattern, cause))
SELECT exp_id, cause, round(max(0.5::DOUBLE + CASE WHEN contains(c, cause) THEN 0.3 ELSE 0 END + CASE WHEN contains(c, 'bounds') OR contains(c, 'range check') THEN 0.2 ELSE 0 END), 6) AS score FROM x JOIN p ON contains(e, pattern) GROUP BY 1, 2""",
}
from strandloom.plans.logs import SQL as _LOGS  # noqa: E402

SQL["herrings"] = f"""WITH c AS ({_LOGS["causal"]}), n AS ({_LOGS["trace_corr"]}) SELECT event_id, symptom_id, round(least(score * CASE WHEN event_type = 'view' THEN 0.5::DOUBLE ELSE 1 END + CASE WHEN n_near > 0 THEN 0.3::DOUBLE ELSE 0 END, 1.0::DOUBLE), 6) AS cause_score FROM c JOIN n USING (event_id) JOIN events USING (event_id)"""
