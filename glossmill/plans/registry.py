"""Queries over versioned datasets, kernels and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossmill.operators import kernels, lineage, registration, registry
from glossmill.plans import query
from glossmill.plans.inputs import (
    SQL_KERNELS, SQL_LINKS, SQL_STAMP, SQL_VERSIONS, dataset_rows, dataset_versions, kernel_versions, run_links, stamp, table,
)
from glossmill.session import cut, tasks_for

PAGE = 5  # small, so that the data fills several pages of a key


@query("registry_list", f"""
WITH {SQL_VERSIONS}
SELECT id, name, version, source_type, strftime(created_at, '{SQL_STAMP}') AS created_at
FROM versions WHERE source_type = 'etl'
""")
def registry_list(spark, folder):
    listed = registry.list_versions(dataset_versions(spark, folder), source_type="etl")
    return listed.select("id", "name", F.col("version").cast("bigint"), "source_type", stamp("created_at").alias("created_at"))


@query("assign_versions", f"""
WITH {SQL_VERSIONS}, highest AS (
  SELECT 'set-' || CAST(c_custkey AS VARCHAR) AS name, CAST(c_nationkey AS BIGINT) AS top FROM customer)
SELECT v.id, v.name, CAST(v.version + coalesce(h.top, 0) AS BIGINT) AS version
FROM versions v LEFT JOIN highest h ON v.name = h.name
""")
def assign_versions(spark, folder):
    new = dataset_rows(spark, folder)
    existing = table(spark, folder, "customer").select(
        F.concat(F.lit("set-"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_nationkey").cast("bigint").alias("version")
    )
    return registry.assign_versions(new, existing, ["created_at", "id"]).select("id", "name", F.col("version").cast("bigint"))


@query("latest_versions", f"""
WITH {SQL_VERSIONS}
SELECT name, arg_max(id, version) AS id, CAST(max(version) AS BIGINT) AS version FROM versions GROUP BY name
""")
def latest_versions(spark, folder):
    return registry.latest_versions(dataset_versions(spark, folder)).select("name", "id", F.col("version").cast("bigint"))


@query("distinct_names", f"WITH {SQL_VERSIONS} SELECT DISTINCT name FROM versions")
def distinct_names(spark, folder):
    return registry.distinct_names(dataset_versions(spark, folder))


@query("resolve_refs", f"""
WITH {SQL_VERSIONS}, refs AS (
  SELECT c_custkey AS ref_id, 'set-' || CAST(c_custkey AS VARCHAR) AS name,
    CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey % 5 AS BIGINT) END AS wanted FROM customer),
newest AS (SELECT name, max(version) AS version FROM versions GROUP BY name)
SELECT r.ref_id, v.name, CAST(v.version AS BIGINT) AS version, v.id
FROM refs r JOIN newest n ON r.name = n.name
JOIN versions v ON v.name = r.name AND v.version = coalesce(r.wanted, n.version)
""")
def resolve_refs(spark, folder):
    suffix = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit(":"), (F.col("c_nationkey") % 5).cast("string"))).otherwise("")
    refs = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("ref_id"), F.concat(F.lit("set-"), F.col("c_custkey").cast("string"), suffix).alias("ref")
    )
    found = registry.resolve_refs(refs, dataset_versions(spark, folder))
    return found.select("ref_id", "name", F.col("version").cast("bigint"), "id")


@query("datasets_by_run", f"""
WITH {SQL_VERSIONS}, {SQL_LINKS}
SELECT v.id, v.name, CAST(v.version AS BIGINT) AS version, l.run_id, l.link_type
FROM versions v JOIN links l ON v.id = l.dataset_version_id
""")
def datasets_by_run(spark, folder):
    joined = registry.datasets_for_runs(dataset_versions(spark, folder), run_links(spark, folder))
    return joined.select("id", "name", F.col("version").cast("bigint"), "run_id", "link_type")


@query("datasets_with_links", f"""
WITH {SQL_VERSIONS}, {SQL_LINKS}, placed AS (
  SELECT *, (row_number() OVER (PARTITION BY dataset_version_id ORDER BY run_id, link_type) - 1) // {PAGE} AS page,
    count(*) OVER (PARTITION BY dataset_version_id) AS n FROM links),
listed AS (
  SELECT dataset_version_id, page, max(n) AS n, string_agg(run_id || '/' || link_type, ',' ORDER BY run_id, link_type) AS runs
  FROM placed GROUP BY dataset_version_id, page)
SELECT v.id, v.name, CAST(coalesce(l.page, 0) AS INTEGER) AS page, coalesce(l.runs, '') AS runs, coalesce(l.n, 0) AS n_runs
FROM versions v LEFT JOIN listed l ON v.id = l.dataset_version_id
""")
def datasets_with_links(spark, folder):
    nested = registry.with_links(dataset_versions(spark, folder), run_links(spark, folder), PAGE)
    texts = F.transform("runs", lambda r: F.concat(r["run_id"], F.lit("/"), r["link_type"]))
    return nested.select("id", "name", "page", F.array_join(texts, ",").alias("runs"), "n_runs")


@query("replace_links", f"""
WITH {SQL_LINKS}
SELECT dataset_version_id, run_id, link_type, strftime(created_at, '{SQL_STAMP}') AS created_at, CAST(line AS BIGINT) AS line FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_version_id, run_id, link_type ORDER BY created_at DESC, line DESC) AS rn FROM links)
WHERE rn = 1
""")
def replace_links(spark, folder):
    newest = [F.col("created_at").desc(), F.col("line").desc()]
    kept = registry.replace_latest(run_links(spark, folder), ["dataset_version_id", "run_id", "link_type"], newest)
    return kept.select("dataset_version_id", "run_id", "link_type", stamp("created_at").alias("created_at"), F.col("line").cast("bigint"))


@query("lineage_turns", """
WITH RECURSIVE nodes AS (
  SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id FROM conversations),
chain AS (
  SELECT id AS start, 0 AS depth, id AS node, parent_id FROM nodes
  WHERE id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL)
  UNION ALL
  SELECT c.start, c.depth + 1, n.id, n.parent_id FROM chain c JOIN nodes n ON n.id = c.parent_id)
SELECT start, CAST(depth AS BIGINT) AS depth, node FROM chain
""")
def lineage_turns(spark, folder):
    node = F.col("conv_id") * 1000 + F.col("turn")
    nodes = table(spark, folder, "conversations").select(node.alias("id"), F.when(F.col("turn") > 0, node - 1).alias("parent_id"))
    return lineage.lineage(nodes)


@query("lineage_text", f"""
WITH {SQL_VERSIONS}, labelled AS (SELECT name, version, name || ':' || CAST(version AS VARCHAR) AS label FROM versions),
steps AS (
  SELECT v.name, l.label, l.version, first_value(v.id) OVER (PARTITION BY v.name ORDER BY v.version DESC) AS start,
    max(v.version) OVER (PARTITION BY v.name) - v.version AS depth
  FROM versions v JOIN labelled l ON v.name = l.name AND v.version = l.version)
SELECT start, CAST(depth // {PAGE} AS BIGINT) AS page, string_agg(label, ' <- ' ORDER BY version DESC) AS lineage
FROM steps GROUP BY start, depth // {PAGE}
""")
def lineage_text(spark, folder):
    with tasks_for(spark, dataset_rows(spark, folder).count()):
        versions = cut(dataset_versions(spark, folder).select("id", "name", "version"))
        parents = versions.select("name", (F.col("version") + 1).alias("version"), F.col("id").alias("parent_id"))
        linked = versions.join(parents, ["name", "version"], "left")
        chains = lineage.lineage(linked.select("id", "parent_id"))
        labels = versions.select(F.col("id").alias("node"), registry.ref_text("name", "version").alias("label"))
        return cut(lineage.lineage_text(chains.join(labels, "node"), "label", PAGE).select("start", "page", "lineage"))


@query("upsert_models", """
WITH old AS (SELECT c_custkey AS handle, c_mktsegment AS base_model, CAST(c_acctbal AS DOUBLE) AS score, c_name AS notes FROM customer),
new AS (
  SELECT o_custkey * 2 AS handle, max(o_orderpriority) AS base_model,
    max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS score
  FROM orders GROUP BY o_custkey)
SELECT coalesce(o.handle, n.handle) AS handle, coalesce(n.base_model, o.base_model, 'unknown') AS base_model,
  coalesce(n.score, o.score) AS score, o.notes AS notes
FROM old o FULL OUTER JOIN new n ON o.handle = n.handle
""")
def upsert_models(spark, folder):
    old = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("handle"), F.col("c_mktsegment").alias("base_model"), F.col("c_acctbal").alias("score"), F.col("c_name").alias("notes")
    )
    new = table(spark, folder, "orders").groupBy((F.col("o_custkey") * 2).alias("handle")).agg(
        F.max("o_orderpriority").alias("base_model"),
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("score"),
    )
    return registry.upsert(old, new, ["handle"], {"base_model": F.lit("unknown")})


@query("ensure_keys", """
SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS id FROM nation
UNION ALL
SELECT p_name, sha256(p_name) FROM (SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT n_name FROM nation))
""")
def ensure_keys(spark, folder):
    known = table(spark, folder, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    return registry.ensure_keys(known, table(spark, folder, "part").select(F.col("p_name").alias("name"))).select("name", "id")


@query("kernel_summary", f"""
WITH {SQL_KERNELS}
SELECT kernel, max(version) AS current_version, arg_max(strategy, (timestamp, version)) AS strategy,
  strftime(max(timestamp), '{SQL_STAMP}') AS last_run,
  arg_max(status, (timestamp, version)) FILTER (status IS NOT NULL) AS last_status
FROM kernels GROUP BY kernel
""")
def kernel_summary(spark, folder):
    summary = kernels.kernel_summary(kernel_versions(spark, folder))
    return summary.withColumn("last_run", stamp("last_run"))


@query("latest_kernel", f"""
WITH {SQL_KERNELS}
SELECT kernel, max(version) AS version, arg_max(coalesce(status, '-'), version) AS status FROM kernels GROUP BY kernel
""")
def latest_kernel(spark, folder):
    return kernels.latest_kernel(kernel_versions(spark, folder)).select("kernel", "version", F.coalesce("status", F.lit("-")).alias("status"))


@query("kernel_history", f"""
WITH {SQL_KERNELS}
, placed AS (SELECT *, (row_number() OVER (PARTITION BY kernel ORDER BY version) - 1) // {PAGE} AS page FROM kernels)
SELECT kernel, CAST(page AS INTEGER) AS page, string_agg(CAST(version AS VARCHAR) || ':' || coalesce(status, '-'), ' ' ORDER BY version) AS versions
FROM placed GROUP BY kernel, page
""")
def kernel_history(spark, folder):
    history = kernels.kernel_history(kernel_versions(spark, folder), PAGE)
    texts = F.transform("versions", lambda v: F.concat(v["version"].cast("string"), F.lit(":"), F.coalesce(v["status"], F.lit("-"))))
    return history.select("kernel", "page", F.array_join(texts, " ").alias("versions"))


@query("kernel_rows", f"""
WITH {SQL_KERNELS} SELECT kernel, version, status FROM kernels
""")
def kernel_rows(spark, folder):
    history = kernels.kernel_history(kernel_versions(spark, folder), PAGE)
    return kernels.kernel_versions(history).select("kernel", "version", "status")


@query("apply_status", f"""
WITH {SQL_KERNELS}, updates AS (
  SELECT o_custkey AS kernel, o_orderkey AS version, l_shipdate AS updated_at, l_linenumber AS line,
    CASE l_returnflag WHEN 'R' THEN 'error' ELSE 'complete' END AS status,
    CASE l_linestatus WHEN 'F' THEN 'run-' || CAST(l_suppkey AS VARCHAR) END AS run_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
newest AS (
  SELECT kernel, version, max(updated_at) AS updated_at, max_by(status, (updated_at, status)) AS status,
    max_by(coalesce(run_id, ''), (updated_at, coalesce(run_id, ''))) AS run_id
  FROM updates GROUP BY kernel, version)
SELECT k.kernel, k.version, coalesce(n.status, k.status) AS status, nullif(n.run_id, '') AS run_id
FROM kernels k LEFT JOIN newest n ON k.kernel = n.kernel AND k.version = n.version
""")
def apply_status(spark, folder):
    items = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("version"),
        F.col("l_shipdate").alias("updated_at"),
        F.when(F.col("l_returnflag") == "R", "error").otherwise("complete").alias("status"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("run-"), F.col("l_suppkey").cast("string"))).otherwise("").alias("run_id"),
    )
    last = items.groupBy("version", "updated_at").agg(F.max("status").alias("status"), F.max("run_id").alias("run_id"))
    versions = kernel_versions(spark, folder)
    updates = last.join(versions.select("version", "kernel"), "version").withColumn("run_id", F.nullif("run_id", F.lit("")))
    return kernels.apply_status(versions, updates)[0].select("kernel", "version", "status", "run_id")


@query("models_nested", f"""
WITH placed AS (
  SELECT *, (row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1) // {PAGE} AS page,
    count(*) OVER (PARTITION BY p_name) AS n_versions, count(*) FILTER (p_size = 1) OVER (PARTITION BY p_name) AS n_aliases FROM part)
SELECT p_name AS name, CAST(page AS INTEGER) AS page,
  string_agg(CAST(p_partkey AS VARCHAR) || ':' || p_type, ' ' ORDER BY p_partkey) AS versions,
  coalesce(string_agg('alias-' || CAST(p_partkey AS VARCHAR), ' ' ORDER BY p_partkey) FILTER (p_size = 1), '') AS aliases,
  max(n_versions) AS n_versions, max(n_aliases) AS n_aliases
FROM placed GROUP BY p_name, page
""")
def models_nested(spark, folder):
    versions = table(spark, folder, "part").select(
        F.col("p_name").alias("name"), F.col("p_partkey").alias("version"), F.col("p_type").alias("status"), F.col("p_brand").alias("run_id"),
        F.when(F.col("p_size") == 1, F.concat(F.lit("alias-"), F.col("p_partkey").cast("string"))).alias("alias"),
    )
    nested = kernels.models_nested(versions, PAGE)
    texts = F.transform("versions", lambda v: F.concat(v["version"].cast("string"), F.lit(":"), v["status"]))
    aliases = F.array_join(F.transform(F.array_sort(F.map_values("aliases")), lambda v: F.concat(F.lit("alias-"), v.cast("string"))), " ")
    return nested.select("name", "page", F.array_join(texts, " ").alias("versions"), aliases.alias("aliases"), "n_versions", "n_aliases")


@query("scoreboard", """
WITH models AS (
  SELECT c_nationkey AS competition, CASE c_mktsegment WHEN 'BUILDING' THEN 'active' WHEN 'MACHINERY' THEN 'testing' ELSE 'archived' END AS status FROM customer),
subs AS (SELECT s_nationkey AS competition, s_acctbal AS score FROM supplier),
m AS (SELECT competition, count(*) AS models, count(*) FILTER (status = 'active') AS active,
  count(*) FILTER (status = 'testing') AS testing, count(*) FILTER (status = 'archived') AS archived FROM models GROUP BY 1),
s AS (SELECT competition, count(*) AS submissions, max(score) AS hi, min(score) AS lo FROM subs GROUP BY 1)
SELECT n_nationkey AS competition, CASE WHEN n_regionkey % 2 = 0 THEN 'maximize' ELSE 'minimize' END AS metric_direction,
  coalesce(models, 0) AS models, coalesce(active, 0) AS active, coalesce(testing, 0) AS testing, coalesce(archived, 0) AS archived,
  coalesce(submissions, 0) AS submissions, CASE WHEN n_regionkey % 2 = 0 THEN hi ELSE lo END AS best_score
FROM nation LEFT JOIN m ON n_nationkey = m.competition LEFT JOIN s ON n_nationkey = s.competition
""")
def scoreboard(spark, folder):
    segment = F.col("c_mktsegment")
    status = F.when(segment == "BUILDING", "active").when(segment == "MACHINERY", "testing").otherwise("archived")
    models = table(spark, folder, "customer").select(F.col("c_nationkey").alias("competition"), status.alias("status"))
    submissions = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("competition"), F.col("s_acctbal").alias("public_score"))
    direction = F.when(F.col("n_regionkey") % 2 == 0, "maximize").otherwise("minimize")
    competitions = table(spark, folder, "nation").select(F.col("n_nationkey").alias("competition"), direction.alias("metric_direction"))
    return kernels.scoreboard(models, submissions, competitions)


@query("recent_submissions", f"""
SELECT competition, id, strftime(ts, '{SQL_STAMP}') AS ts FROM (
  SELECT o_custkey AS competition, o_orderkey AS id, o_orderdate AS ts,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn <= 5
""")
def recent_submissions(spark, folder):
    submissions = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("competition"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("timestamp")
    )
    return kernels.recent_submissions(submissions).select("competition", "id", stamp("timestamp").alias("ts"))


@query("missing_refs", r"""
WITH refs AS (
  SELECT DISTINCT page_id, lower(ref) AS ref FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS ref FROM pages))
SELECT page_id, ref FROM refs WHERE ref NOT IN (SELECT p FROM (
  SELECT DISTINCT lower(regexp_extract(text, '^([^ ]+)', 1)) AS p FROM benchmark))
""")
def missing_refs(spark, folder):
    from glossmill.operators.rules import extract_refs

    refs = extract_refs(table(spark, folder, "pages"), ["page_id"], "html", ['href="/([^"]*)"'])
    attached = table(spark, folder, "benchmark").select(F.lower(F.regexp_extract("text", "^([^ ]+)", 1)).alias("ref"))
    return registry.missing_refs(refs.select("page_id", F.lower("ref").alias("ref")), attached, ["ref"]).select("page_id", "ref")


@query("schema_violations", """
WITH used AS (SELECT DISTINCT event_type AS dataset, 'k' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS VARCHAR) AS column_name FROM events),
known AS (SELECT DISTINCT event_type AS dataset, 'k' || CAST(user_id % 3 AS VARCHAR) AS column_name FROM events WHERE event_type <> 'view')
SELECT dataset, column_name FROM used u
WHERE dataset IN (SELECT dataset FROM known) AND column_name <> 'k6'
  AND NOT EXISTS (SELECT 1 FROM known k WHERE k.dataset = u.dataset AND k.column_name = u.column_name)
""")
def schema_violations(spark, folder):
    events = table(spark, folder, "events")
    number = F.get_json_object("props", "$.k").cast("bigint")
    used = events.select(F.col("event_type").alias("dataset"), F.concat(F.lit("k"), (number % 7).cast("string")).alias("column_name"))
    known = events.where("event_type <> 'view'").select(
        F.col("event_type").alias("dataset"), F.concat(F.lit("k"), (F.col("user_id") % 3).cast("string")).alias("column_name")
    )
    return registry.schema_violations(used, known, ["k6"])


LINE_TEXT = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus"))


@query("register_datasets", f"""
WITH rows AS (SELECT 'lines-' || CAST(l_suppkey AS VARCHAR) AS name, l_returnflag AS flag, {LINE_TEXT} AS t FROM lineitem),
described AS (
  SELECT name, flag, count(*) AS row_count, CAST(sum(strlen(t)) AS BIGINT) AS size_bytes,
    md5(CAST(count(*) AS VARCHAR) || '|' || CAST(bit_xor(CAST('0x' || substr(md5(t), 1, 15) AS BIGINT)) AS VARCHAR) || '|'
      || CAST(sum(CAST('0x' || substr(md5(t), 17, 15) AS BIGINT)) AS VARCHAR)) AS checksum
  FROM rows GROUP BY name, flag),
numbered AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY flag) AS version, min(flag) OVER (PARTITION BY name) AS first_flag FROM described),
made AS (SELECT *, sha256(name || ':' || CAST(version AS VARCHAR) || ':' || checksum) AS id FROM numbered WHERE first_flag = 'A')
SELECT m.id, m.name, m.version, CASE WHEN m.version > 1 THEN p.id END AS parent_version_id, m.row_count, m.size_bytes, m.checksum,
  m.flag AS source_path, CASE WHEN m.flag = 'N' THEN replace(m.name, 'lines', 'run') END AS run_id
FROM made m JOIN made p ON p.name = m.name AND p.version = 1
""")
def register_datasets(spark, folder):
    """A supplier's lines by return flag are the versions of a data set; the first flag is registered first, then all flags twice."""
    from uuid import uuid4

    from glossmill.session import ensure_checkpoint_dir

    store = f"{ensure_checkpoint_dir(spark)}/registry-{uuid4().hex}"
    lines = table(spark, folder, "lineitem").select(
        F.concat(F.lit("lines-"), F.col("l_suppkey").cast("string")).alias("name"), F.col("l_returnflag").alias("source_path"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_linestatus",
    )
    first, later = F.col("source_path") == "A", F.col("source_path") > "A"
    described = registration.describe(lines, ["name", "source_path"]).withColumns({
        "parent": F.when(later, F.concat("name", F.lit(":1"))),
        "run_id": F.when(F.col("source_path") == "N", F.replace("name", F.lit("lines"), F.lit("run"))),
    })
    registration.register(described.where(first), store, ["source_path"])
    for _ in range(2):
        registration.register(described, store, ["source_path"])
    links = registration.registered_links(spark, store).select(F.col("dataset_version_id").alias("id"), "run_id")
    columns = ["id", "name", "version", "parent_version_id", "row_count", "size_bytes", "checksum", "source_path"]
    return registration.registered(spark, store).select(*columns).join(links, "id", "left")
