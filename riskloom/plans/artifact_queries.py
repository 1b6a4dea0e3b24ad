"""Registered queries on signatures, wheels and enrichment, with the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import texts
from ..operators import graph, rules, scoring, setjoin, similarity, tables
from ..operators import signatures as G
from .bindings import Inputs
from .queries import _RULES_SQL, _hits, epss_sql, level_sql, query


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _matches(pattern: str, text: str = "content") -> str:
    return f"regexp_matches({text}, '{_q(pattern)}')"


def _count(pattern: str, text: str = "content") -> str:
    return f"len(regexp_extract_all({text}, '{_q(pattern)}'))"


def _kept(items: list[str]) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def _rules_sql(table: tuple) -> str:
    return " UNION ALL ".join(f"SELECT source_id, '{r.id}' AS rule, '{r.category}' AS behaviour, '{r.severity}' AS severity, m AS matched FROM (SELECT source_id, {' + '.join(f'cast({_matches(p)} AS int)' for p in r.patterns)} AS m FROM binary_strings) WHERE m >= {r.least}" for r in table)


# --- strings ----------------------------------------------------------------------


@query(_rules_sql(G.STRING_RULES))
def r5_string_signatures(t: Inputs) -> DataFrame:
    return G.string_hits(t["binary_strings"], "content", ["source_id"])


@query(f"""{_rules_sql(G.BINARY_RULES)} UNION ALL SELECT artifact_id, 'HighEntropy_Section', 'obfuscation', 'medium', 1 FROM (SELECT artifact_id, sum(-c / cast(n AS double) * log2(c / cast(n AS double))) AS e FROM (
  SELECT artifact_id, byte, count(*) AS c, sum(count(*)) OVER (PARTITION BY artifact_id) AS n FROM (SELECT artifact_id, substr(h, 2 * i - 1, 2) AS byte FROM (SELECT artifact_id, hex(data) AS h, unnest(range(1, octet_length(data) + 1)) AS i FROM binaries)) GROUP BY 1, 2) GROUP BY 1) WHERE e > 7.5""")
def r4_binary_rules(t: Inputs) -> DataFrame:
    return G.binary_hits(t["binary_strings"], "content", "data", ["source_id"], t["binaries"].withColumnRenamed("artifact_id", "source_id"))


_BEHAVIOUR_SQL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.CATEGORY_BEHAVIOUR.items()) + " END"


@query(f"SELECT source_id, behaviour, count(*) AS n_details, 0.75 AS confidence FROM (SELECT source_id, {_BEHAVIOUR_SQL} AS behaviour FROM ({_RULES_SQL})) WHERE behaviour IS NOT NULL GROUP BY 1, 2")
def r17_heuristic_behaviours(t: Inputs) -> DataFrame:
    return G.heuristic_behaviours(_hits(t), ["source_id"])


@query(" UNION ALL ".join(f"SELECT source_id, '{p}' AS profile, '{s}' AS severity, '{c}' AS behaviour FROM binary_strings WHERE ({' OR '.join(map(_matches, a))}) AND ({' OR '.join(map(_matches, b))})" for p, s, c, a, b in G.COORDINATED))
def a17_coordinated_profiles(t: Inputs) -> DataFrame:
    return G.coordinated(t["binary_strings"], "content", ["source_id"])


# --- calls --------------------------------------------------------------------------


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _number_sql(x: str, numbers: dict[int, str]) -> str:
    return f"CASE regexp_replace(lower({x}), '^(?:0x)?0*', '') " + " ".join(f"WHEN '{n:x}' THEN '{v}'" for n, v in numbers.items()) + " END"


_KNOWN = _list(G.MEMORY_CALLS + G.PROCESS_CALLS + G.FILE_CALLS + G.NETWORK_CALLS + G.SANDBOX_CALLS)
_TOKENS = "[]::VARCHAR[]"
for _p, _must in G.CALL_MARKS:
    _TOKENS = f"list_concat({_TOKENS}, list_filter(list_transform(regexp_extract_all(content, '{_p}', 1), lambda x: lower(x)), lambda x: {f'list_contains({_KNOWN}, x)' if _must else 'true'}))"
_TOKENS = f"list_concat({_TOKENS}, list_filter(list_transform(regexp_extract_all(content, '{G.CALL_NUMBER}', 1), lambda x: {_number_sql('x', G.CALL_NUMBERS)}), lambda x: x IS NOT NULL))"


def _exact_chain(chain: str) -> str:
    return r"\|(?:.*\|)?".join(f"(?:{'|'.join(s)})" for s in G.slots(chain))


_SEQUENCE_HITS = _kept([f"CASE WHEN regexp_matches(s, '\\|{_exact_chain(c)}\\|'){f' AND {_matches(G.SENSITIVE_PATH)}' if n in G.NEEDS_PATH else ''} THEN '{n}' END" for n, c in G.SEQUENCES.items()])


@query(f"""SELECT source_id, array_to_string(m, ',') AS matched, CASE WHEN len(m) = 0 THEN array_to_string(u, ',') ELSE '' END AS suspicious, CASE WHEN len(m) >= 3 THEN 0.95 WHEN len(m) = 2 THEN 0.88 WHEN len(m) = 1 THEN 0.8 ELSE 0.55 END AS confidence
  FROM (SELECT source_id, {_SEQUENCE_HITS} AS m, list_sort(list_distinct(list_filter(toks, lambda x: list_contains({_list(G.PROCESS_CALLS + G.MEMORY_CALLS)}, x)))) AS u
  FROM (SELECT *, concat('|', array_to_string(toks, '|'), '|') AS s FROM (SELECT source_id, content, {_TOKENS} AS toks FROM binary_strings))) WHERE len(m) > 0 OR len(u) >= 3""")
def r8_call_sequences(t: Inputs) -> DataFrame:
    return G.call_sequences(t["binary_strings"], "content", ["source_id"])


_MAX_JUMPS = f"CASE WHEN length(content) < 512 THEN {_count(G.JUMPS)} ELSE list_max(list_transform(range(0, length(content) // 512), lambda i: {_count(G.JUMPS, 'substr(content, i * 512 + 1, 512)')})) END"
_BUSY = f"{_count(G.INSTRUCTIONS)} > 20"
_FLOW = f"""SELECT *, CASE WHEN max_jumps > 20 THEN 'high' WHEN max_jumps > 10 THEN 'medium' END AS jumps, CASE WHEN n_dispatch >= 6 THEN 'high' WHEN n_dispatch >= 3 THEN 'medium' END AS dispatch FROM (SELECT source_id, content, {_MAX_JUMPS} AS max_jumps, {_count(G.INDIRECT)} AS n_dispatch,
  CASE WHEN {_BUSY} AND NOT {_matches(G.PROLOGUE)} THEN 'low' END AS prologue, CASE WHEN {_BUSY} AND NOT {_matches(G.EPILOGUE)} THEN 'low' END AS epilogue FROM binary_strings)"""


@query(f"SELECT source_id, max_jumps, jumps, prologue, epilogue, n_dispatch, dispatch FROM ({_FLOW}) WHERE coalesce(jumps, prologue, epilogue, dispatch) IS NOT NULL")
def r10_control_flow(t: Inputs) -> DataFrame:
    return G.flow_anomalies(t["binary_strings"], "content", ["source_id"])


def _places(prio: int, pattern: str, name: str, keep: str) -> str:
    """Name and offset of every match: what stands before it is split pieces and earlier matches."""
    p = f"(?i){pattern}"
    at = "list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT source_id, {at} AS place, {prio} AS prio, {name} AS name FROM (SELECT source_id, m, p, i, lower(g[i]) AS g FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
  SELECT source_id, regexp_extract_all(content, '{p}') AS m, regexp_extract_all(content, '{p}', 1) AS g, string_split_regex(content, '{p}') AS p FROM binary_strings))) WHERE {keep}"""


_CALLED = "regexp_replace(regexp_replace(g, '@plt$', ''), '<[^>]+>$', '')"
_NODES = " UNION ALL ".join([
    _places(1, G.NAMED, "g", f"NOT list_contains({_list(G.KEYWORDS)}, g) AND NOT regexp_matches(g, '^(?:{'|'.join(G.NOT_BEGUN)})')"),
    _places(2, G.MNEMONIC, _CALLED, f"NOT list_contains({_list(['', *G.KEYWORDS])}, {_CALLED})"),
    _places(3, G.MARKED, "g", "true"),
    _places(4, G.COMMENT, "g", f"list_contains({_list(G.COMMENT_CALLS)}, g)"),
    _places(5, G.NUMBERED, _number_sql("g", G.NODE_NUMBERS), f"{_number_sql('g', G.NODE_NUMBERS)} IS NOT NULL"),
])
_CHAIN_HITS = _kept([
    f"CASE WHEN regexp_matches(s, '{'.*[|].*'.join('(?:' + '|'.join(x) + ')' for x in G.slots(c.slots))}')"
    + (f" AND ({' OR '.join(f'contains(lower(content), {chr(39)}{x.lower()}{chr(39)})' for x in c.context)})" if c.context else "")
    + f" THEN {{'id': '{c.id}', 'c': cast({c.confidence} AS double)}} END"
    for c in G.CHAINS
])


@query(f"""SELECT source_id, array_to_string(list_transform(h, lambda x: x.id), ',') AS signatures, len(h) AS n_signatures,
  round(CASE WHEN len(h) > 0 THEN least(0.95, list_max(list_transform(h, lambda x: x.c)) + least(0.1, (len(h) - 1) * 0.03) + CASE WHEN high THEN 0.05 ELSE 0 END) WHEN high THEN 0.6 ELSE 0.5 END, 4) AS confidence
  FROM (SELECT f.source_id, {_CHAIN_HITS} AS h, coalesce(jumps = 'high', false) OR coalesce(dispatch = 'high', false) AS high, jumps IS NOT NULL OR dispatch IS NOT NULL AS anomaly FROM ({_FLOW}) f
  LEFT JOIN (SELECT source_id, string_agg(name, '|' ORDER BY place) AS s FROM (SELECT *, row_number() OVER (PARTITION BY source_id, place ORDER BY prio) AS k FROM ({_NODES})) WHERE k = 1 GROUP BY 1) n ON n.source_id = f.source_id) WHERE len(h) > 0 OR anomaly""")
def r9_call_chains(t: Inputs) -> DataFrame:
    return G.call_chains(t["binary_strings"], "content", ["source_id"])


# --- bytes ---------------------------------------------------------------------------


_HEAD = "substr(hex(data), 1, 1024)"


@query(f"SELECT artifact_id, array_to_string({_kept([f'CASE WHEN regexp_matches({_HEAD}, {chr(39)}^(?:..)*{m}{chr(39)}) THEN {chr(39)}{n}{chr(39)} END' for n, m in rules.PACKERS.items()])}, ',') AS packers FROM binaries WHERE data IS NOT NULL")
def r11_packers(t: Inputs) -> DataFrame:
    return t["binaries"].filter("data is not null").select("artifact_id", F.array_join(rules.packers(F.col("data")), ",").alias("packers"))


def _words_sql(name: str, severity: str, least: int, exact: bool, words: str) -> str:
    n = " + ".join(f"cast(contains({'content' if exact else 'lower(content)'}, '{w if exact else w.lower()}') AS int)" for w in words.split())
    return f"({n}) >= {least}"


_EXT = [(n, s, _words_sql(n, s, k, e, w)) for n, s, k, e, w in G.EXTENSION_PATTERNS]
_EXT.insert(1, ("high_entropy", "medium", f"entropy >= {G.EXTENSION_ENTROPY}"))


@query(f"""SELECT source_id, patterns, base_score, least(100, base_score + {epss_sql('epss_percentile', 'd')}) AS risk_score FROM (SELECT source_id, epss_percentile, array_to_string({_kept([f"CASE WHEN {x} THEN '{n}' END" for n, _, x in _EXT])}, ',') AS patterns,
  least(100, {' + '.join(f"CASE WHEN {x} THEN {G.EXTENSION_POINTS[s]} ELSE 0 END" for _, s, x in _EXT)}) AS base_score FROM binary_strings)""")
def a29_extension_risk(t: Inputs) -> DataFrame:
    return G.extension_risk(t["binary_strings"], "content", "entropy", "epss_percentile", ["source_id"])


# --- enrichment ------------------------------------------------------------------------


@query("""SELECT advisory_id, date_added AS kev_date, m AS maturity, NOT (a.kev_date IS NOT DISTINCT FROM date_added AND a.m0 IS NOT DISTINCT FROM m) AS updated FROM (SELECT *, CASE WHEN kev_date IS NOT NULL THEN 'active-exploitation' END AS m0 FROM advisories WHERE source_id LIKE 'CVE-%') a
  JOIN (SELECT upper(cve_id) AS id, date_added, CASE WHEN ransomware = 'Known' THEN 'widespread' ELSE 'active-exploitation' END AS m FROM kev_catalogue) k ON k.id = upper(a.source_id)""")
def j11_kev_enrichment(t: Inputs) -> DataFrame:
    a = t["advisories"].withColumn("maturity", F.when(F.col("kev_date").isNotNull(), "active-exploitation"))
    return tables.kev_enrichment(a, t["kev_catalogue"]).select("advisory_id", "kev_date", "maturity", "updated")


_PCT = "cast(floor(epss_percentile * 100 + 0.5) AS int)"
_EPSS_LABEL = f"concat('EPSS ', cast({_PCT} AS string), 'th percentile (', cve_id, ')')"


@query(f"""SELECT package_id, primary_cve, epss_points, kev_points, boost_reason, risk_score, {level_sql('risk_score')} AS risk_level, CASE WHEN epss_points + kev_points >= 20 THEN 'critical' WHEN epss_points + kev_points >= 10 THEN 'high' WHEN epss_points + kev_points > 0 THEN 'medium' END AS finding_severity
  FROM (SELECT b.package_id, cve_id AS primary_cve, e AS epss_points, k AS kev_points, CASE WHEN e > 0 AND k > 0 THEN concat({_EPSS_LABEL}, ' + CISA KEV active-exploitation') WHEN e > 0 THEN {_EPSS_LABEL} WHEN k > 0 THEN 'CISA KEV active-exploitation' WHEN cve_id IS NULL THEN NULL ELSE concat({_EPSS_LABEL}, ' — below boost threshold') END AS boost_reason,
  greatest(0, least(100, base + e + k + d)) AS risk_score FROM (SELECT *, {epss_sql('epss_percentile', 'b')} AS e, CASE WHEN kev THEN 20 ELSE 0 END AS k, CASE WHEN days < 7 OR adoption < 0.05 THEN 0 WHEN days >= 90 AND adoption >= 0.5 THEN -10 WHEN days >= 30 AND adoption >= 0.25 THEN -5 ELSE 0 END AS d
  FROM (SELECT package_id, cast(floor(max(risk_score) * 0.65 + avg(risk_score) * 0.35 + 0.5) AS int) AS base FROM analyses GROUP BY 1) a
  LEFT JOIN (SELECT * FROM (SELECT package_id AS p, cve_id, epss_percentile, kev, row_number() OVER (PARTITION BY package_id ORDER BY epss_percentile DESC, cve_id, kev DESC) AS i FROM known_cves WHERE fetched_at IS NULL OR fetched_at >= timestamp '1998-06-01' - INTERVAL 30 DAY) WHERE i = 1) c ON c.p = a.package_id
  LEFT JOIN (SELECT p_partkey AS q, p_size * 4 AS days, (p_partkey % 100) / 100.0 AS adoption FROM part) x ON x.q = a.package_id) b)""")
def a7_epss_override(t: Inputs) -> DataFrame:
    base = scoring.package_rollup(t["analyses"], "package_id").select("package_id", "risk_score")
    patches = t["part"].select(F.col("p_partkey").alias("package_id"), (F.col("p_size") * 4).alias("days"), (F.col("p_partkey") % 100 / 100.0).alias("adoption"))
    out = scoring.epss_override(base, t["known_cves"], "package_id", F.lit("1998-06-01 00:00:00").cast("timestamp"), patches)
    return out.select("package_id", "primary_cve", "epss_points", "kev_points", "boost_reason", "risk_score", "risk_level", "finding_severity")


@query("""SELECT advisory_id, CASE WHEN kev_date IS NOT NULL THEN concat(source_id, ' is in the CISA KEV catalogue (added ', strftime(kev_date, '%Y-%m-%d'), ') — patch immediately.') WHEN epss_percentile >= 0.5 THEN concat(source_id, ' has high exploit probability (EPSS ', printf('%.1f', epss_percentile * 100), 'th percentile) — prioritise patching.')
  WHEN cvss_score >= 9 THEN concat(source_id, ' is rated Critical — schedule prompt remediation.') ELSE concat('Review ', source_id, ' and apply the latest patched version.') END AS recommendation FROM advisories JOIN epss_scores USING (advisory_id)""")
def f24_recommendations(t: Inputs) -> DataFrame:
    x = t["advisories"].join(t["epss_scores"].select("advisory_id", "epss_percentile"), "advisory_id")
    severity = F.when(F.col("cvss_score") >= 9, "Critical").otherwise("Low")
    return x.select("advisory_id", texts.recommendation(F.col("source_id"), severity, F.col("epss_percentile"), F.date_format("kev_date", "yyyy-MM-dd")).alias("recommendation"))


@query("""SELECT graph_id, concat(cast(n AS string), ' package', CASE WHEN n <> 1 THEN 's' ELSE '' END, ' in graph; ', CASE WHEN r = 0 THEN 'no risk scores recorded' ELSE concat(CASE WHEN r >= 75 THEN 'CRITICAL' WHEN r >= 50 THEN 'HIGH' WHEN r >= 25 THEN 'MEDIUM' ELSE 'LOW' END, ' max-transitive risk score ', cast(r AS string), '/100') END, '; ',
  CASE WHEN c > 0 THEN concat(cast(c AS string), ' circular dep', CASE WHEN c <> 1 THEN 's' ELSE '' END, ' detected') ELSE 'no circular deps' END, '; ', CASE WHEN o > 0 THEN concat(cast(o AS string), ' orphaned dep', CASE WHEN o <> 1 THEN 's' ELSE '' END) ELSE 'no orphaned deps' END, '.') AS summary
  FROM (SELECT l_orderkey AS graph_id, count(*) AS n, cast(max(l_quantity) * 2 AS int) AS r, count(*) FILTER (l_returnflag = 'R') AS c, count(*) FILTER (l_returnflag = 'A') AS o FROM lineitem GROUP BY 1)""")
def f24_audit_summaries(t: Inputs) -> DataFrame:
    g = t["lineitem"].groupBy(F.col("l_orderkey").alias("graph_id")).agg(F.count("*").alias("n"), (F.max("l_quantity") * 2).cast("int").alias("r"), F.count_if(F.col("l_returnflag") == "R").alias("c"), F.count_if(F.col("l_returnflag") == "A").alias("o"))
    return g.select("graph_id", texts.audit_summary(F.col("n"), F.col("r"), F.col("c"), F.col("o")).alias("summary"))


# --- wheels and source archives ------------------------------------------------------------

_NATIVE = "regexp_matches(lower(path), '\\.(?:so|pyd|dylib)(?:\\.|\\z)')"


@query(f"SELECT package_id, path FROM wheel_files f WHERE {_NATIVE} AND NOT EXISTS (SELECT 1 FROM sdist_modules m WHERE m.package_id = f.package_id AND (string_split(m.name, '.')[-1] = string_split(string_split(f.path, '/')[-1], '.')[1] OR m.name = string_split(string_split(f.path, '/')[-1], '.')[1]))")
def j20_extra_binaries(t: Inputs) -> DataFrame:
    return similarity.extra_binaries(t["wheel_files"], t["sdist_modules"], "package_id")


@query(f"SELECT *, claimed_pure AND n_native > 0 AS suspected FROM (SELECT package_id, filename, regexp_matches(filename, '(?i)-(py2\\.py3|py[23][0-9]*)-none-any\\.whl\\z') AS claimed_pure, (SELECT count(*) FROM wheel_files f WHERE f.package_id = w.package_id AND {_NATIVE}) AS n_native FROM wheels w)")
def r13_pure_python_claims(t: Inputs) -> DataFrame:
    return similarity.pure_python_claims(t["wheels"], t["wheel_files"], "package_id")


@query(f"""SELECT *, CASE WHEN in_artefacts AND NOT abi_tagged THEN 'medium' END AS severity FROM (SELECT package_id, path, len(list_intersect(string_split(lower(path), '/'), {_list(similarity.ARTEFACT_DIRS)})) > 0 AS in_artefacts,
  regexp_matches(path, '(?i)\\.cpython-[0-9]+[^.]*\\.so\\z|\\.pypy[0-9]+-[^.]+\\.so\\z') OR path LIKE '%.pyd' AS abi_tagged FROM wheel_files WHERE regexp_matches(lower(path), '\\.(so|pyd|dll|dylib)\\z'))""")
def r16_archive_binaries(t: Inputs) -> DataFrame:
    return similarity.archive_binaries(t["wheel_files"])


_OTHER = "FROM binary_registry b WHERE b.ecosystem = a.ecosystem AND"


_PAIRS = "list_distinct(list_transform(range(0, len({0}.fuzzy_hash) // 2), lambda i: substr({0}.fuzzy_hash, 2 * i + 1, 2)))"
_BOTH = f"len(list_intersect({_PAIRS.format('a')}, {_PAIRS.format('b')}))"
_FUZZY = f"b.package_name <> a.package_name AND substr(b.fuzzy_hash, 1, 8) = substr(a.fuzzy_hash, 1, 8) AND floor({_BOTH} * 100.0 / (len({_PAIRS.format('a')}) + len({_PAIRS.format('b')}) - {_BOTH}) + 0.5) >= 85"


@query(f"""SELECT artifact_id, kind, CASE WHEN kind <> 'exact' THEN 'medium' WHEN differs THEN 'critical' ELSE 'high' END AS severity FROM (SELECT artifact_id, CASE WHEN EXISTS (SELECT 1 {_OTHER} b.binary_hash = a.binary_hash AND (b.package_name <> a.package_name OR b.version <> a.version)) THEN 'exact'
  WHEN EXISTS (SELECT 1 {_OTHER} b.import_sig = a.import_sig AND b.package_name <> a.package_name) THEN 'import' WHEN EXISTS (SELECT 1 {_OTHER} b.syscall_sig = a.syscall_sig AND b.package_name <> a.package_name) THEN 'syscall'
  WHEN artifact_id IN (SELECT a.artifact_id FROM binary_registry a JOIN binary_registry b ON b.ecosystem = a.ecosystem AND {_FUZZY}) THEN 'fuzzy' END AS kind,
  EXISTS (SELECT 1 {_OTHER} b.binary_hash = a.binary_hash AND (b.package_name <> a.package_name OR b.version <> a.version) AND b.import_sig <> a.import_sig) AS differs FROM binary_registry a) WHERE kind IS NOT NULL""")
def j15_repackaging(t: Inputs) -> DataFrame:
    return setjoin.repackaging(t["binary_registry"])


_GRAMS = "SELECT doc_id, list_distinct(list_transform(range(0, greatest(length(h) // 2 - 1, 0)), lambda i: substr(h, 2 * i + 1, 4))) AS g FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents)"


@query(f"""SELECT doc_id, similarity, similarity >= 70 AS correlated FROM (SELECT a.doc_id, CASE WHEN b.g IS NULL THEN NULL WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0 ELSE cast(floor(len(list_intersect(a.g, b.g)) * 100.0 / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) + 0.5) AS int) END AS similarity
  FROM ({_GRAMS}) a LEFT JOIN ({_GRAMS}) b ON b.doc_id = a.doc_id - 7)""")
def j29_build_similarity(t: Inputs) -> DataFrame:
    # the sets are saved, as both sides of the join read them
    g = graph.checkpointed(t["documents"].select("doc_id", similarity.bigram_set(F.col("text").cast("binary")).alias("g")))
    both = g.join(g.select((F.col("doc_id") + 7).alias("doc_id"), F.col("g").alias("h")).hint("merge"), "doc_id", "left")
    return similarity.correlated_sets(both, "g", "h").drop("g", "h")


@query("SELECT l_orderkey AS release_id, l_linenumber AS n, epoch(o_orderdate) - epoch(l_shipdate - INTERVAL 50 DAY) BETWEEN -300 AND 2592000 AS fresh FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def j29_wheel_freshness(t: Inputs) -> DataFrame:
    x = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select(F.col("l_orderkey").alias("release_id"), F.col("l_linenumber").alias("n"), similarity.wheel_fresh(F.col("l_shipdate") - F.expr("INTERVAL 50 DAYS"), F.col("o_orderdate")).alias("fresh"))


@query("""SELECT package_id, filename, CASE WHEN n >= 3 THEN p[n - 2] END AS python, CASE WHEN n >= 3 THEN p[n - 1] END AS abi, CASE WHEN n >= 3 THEN p[n] END AS platform FROM (SELECT *, len(p) AS n FROM (SELECT package_id, filename, string_split(regexp_replace(filename, '\\.whl$', ''), '-') AS p FROM wheels))""")
def f16_wheel_tags(t: Inputs) -> DataFrame:
    return t["wheels"].withColumn("w", S.wheel_tags(F.col("filename"))).select("package_id", "filename", "w.python", "w.abi", "w.platform")


_TRUSTED = "SELECT DISTINCT package_id FROM script_sources WHERE package_id % 3 = 0"
_HOOKS = f"SELECT source_id, package_id, CASE WHEN category = 'scriptInjection' THEN 'installHook' ELSE category END AS category, title, severity FROM ({_RULES_SQL})"


@query(f"SELECT source_id, package_id, category, title, CASE WHEN category = 'installHook' AND severity IN ('low', 'medium') AND package_id IN ({_TRUSTED}) THEN 'info' ELSE severity END AS severity FROM ({_HOOKS})")
def r3_trusted_demotion(t: Inputs) -> DataFrame:
    hits = _hits(t).withColumn("category", F.when(F.col("category") == "scriptInjection", "installHook").otherwise(F.col("category"))).select("source_id", "package_id", "category", "title", "severity")
    return rules.demote_trusted(hits, t.sql(_TRUSTED), "package_id")


@query(f"SELECT source_id, category, title, severity FROM (SELECT *, row_number() OVER (PARTITION BY source_id, category, title ORDER BY f, severity) AS i FROM (SELECT 0 AS f, source_id, category, title, severity FROM ({_RULES_SQL}) WHERE source_id % 2 = 0 UNION ALL SELECT 1, source_id, category, title, 'low' FROM ({_RULES_SQL}))) WHERE i = 1")
def u2_merged_findings(t: Inputs) -> DataFrame:
    hits = _hits(t).select("source_id", "category", "title", "severity")
    return rules.merge_findings(hits.filter("source_id % 2 = 0"), hits.withColumn("severity", F.lit("low")), ["source_id"])


_CHUNKS = "SELECT doc_id, b, sum(-c / cast(n AS double) * log2(c / cast(n AS double))) AS e FROM (SELECT doc_id, b, byte, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id, b) AS n FROM (SELECT doc_id, (i - 1) // 4096 AS b, substr(h, 2 * i - 1, 2) AS byte FROM (SELECT doc_id, h, unnest(range(1, CASE WHEN k < 4096 THEN k ELSE k - k % 4096 END + 1)) AS i FROM (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS k FROM documents))) GROUP BY 1, 2, 3) GROUP BY 1, 2"


@query(f"SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (e > 7.2) AS n_high, count(*) FILTER (e > 7.2) / count(*) >= 0.4 AS packed FROM ({_CHUNKS}) GROUP BY doc_id")
def w8_packed_chunks(t: Inputs) -> DataFrame:
    return rules.packed_chunks(t["documents"].withColumn("data", F.col("text").cast("binary")), "data", ["doc_id"])


# --- scalar functions that had no query ------------------------------------------------------


_LICENCES = "SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'gpl-3.0' WHEN 1 THEN 'MIT' WHEN 2 THEN ' unlicensed ' WHEN 3 THEN 'Apache-2.0' WHEN 4 THEN '' WHEN 5 THEN 'LGPL-2.1' WHEN 6 THEN NULL WHEN 7 THEN 'See License in LICENSE' ELSE 'ISC' END AS licence FROM orders"


@query(f"SELECT o_orderkey, licence IS NULL OR upper(trim(licence)) IN ({', '.join(f'{chr(39)}{v}{chr(39)}' for v in S.BAD_LICENCES)}) AS bad FROM ({_LICENCES})")
def f17_bad_licences(t: Inputs) -> DataFrame:
    return t.sql(_LICENCES).select("o_orderkey", S.bad_licence(F.col("licence")).alias("bad"))


_NAMES = "SELECT p_partkey AS package_id, CASE p_partkey % 6 WHEN 0 THEN 'sharp' WHEN 1 THEN concat('@esbuild/', p_name) WHEN 2 THEN concat(p_name, '-darwin-arm64') WHEN 3 THEN 'Sharp' ELSE p_name END AS name FROM part"


@query(f"SELECT package_id, name, name IN ({', '.join(f'{chr(39)}{v}{chr(39)}' for v in S.NATIVE_NAMES)}) OR {' OR '.join(f'starts_with(name, {chr(39)}{v}{chr(39)})' for v in S.NATIVE_PREFIXES)} OR {' OR '.join(f'ends_with(name, {chr(39)}{v}{chr(39)})' for v in S.NATIVE_SUFFIXES)} AS native FROM ({_NAMES})")
def f11_native_names(t: Inputs) -> DataFrame:
    return t.sql(_NAMES).select("package_id", "name", S.is_native_name(F.col("name")).alias("native"))


_VECTORS = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('CVSS:3.1/AV:', CASE l_orderkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'A' WHEN 2 THEN 'L' ELSE 'P' END, '/AC:', CASE WHEN l_suppkey % 2 = 0 THEN 'L' ELSE 'H' END, '/C:', CASE WHEN l_partkey % 3 = 0 THEN 'H' ELSE 'N' END, '/I:', CASE WHEN l_partkey % 5 = 0 THEN 'H' ELSE 'L' END) END AS vector FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN vector IS NULL THEN NULL WHEN vector LIKE '%/AV:N/AC:L%' AND (vector LIKE '%/C:H%' OR vector LIKE '%/I:H%') THEN 'CRITICAL' WHEN vector LIKE '%/AV:N%' THEN 'HIGH' WHEN vector LIKE '%/AV:A%' OR vector LIKE '%/AV:L%' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM ({_VECTORS})")
def f8_vector_severity(t: Inputs) -> DataFrame:
    return t.sql(_VECTORS).select("l_orderkey", "l_linenumber", S.vector_severity(F.col("vector")).alias("severity"))
