"""Views of the given tables in the shapes the operators take.

Each view is one SQL text that Spark and other engines read alike; a view may
use tables and views listed before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tracewell.operators.store import save

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "v_doc": """
        SELECT source AS repo_id, concat('src/', lang, '/', cast(doc_id AS string),
               CASE doc_id % 6 WHEN 0 THEN '.dart' WHEN 1 THEN '.ts' WHEN 2 THEN '.go' WHEN 3 THEN '.g.dart' WHEN 4 THEN '.min.js' ELSE '.md' END) AS path,
               text AS content, doc_id, lang
        FROM documents""",
    "v_doc_prev": """
        SELECT repo_id, path, CASE WHEN doc_id % 10 = 0 THEN concat(content, ' ') ELSE content END AS content, doc_id % 4 + 1 AS version
        FROM v_doc WHERE doc_id % 13 <> 0""",
    "v_path": """
        SELECT page_id, CASE page_id % 9
               WHEN 0 THEN '' WHEN 1 THEN concat('/', url) WHEN 2 THEN concat('a/../', cast(page_id AS string)) WHEN 3 THEN concat('a//b/./', cast(page_id AS string), '.TS')
               WHEN 4 THEN concat('lib/pages/', cast(page_id AS string), '.dart') WHEN 5 THEN concat('lib/data/user_repository', cast(page_id % 7 AS string), '.kt')
               WHEN 6 THEN concat('win', chr(92), cast(page_id AS string)) WHEN 7 THEN concat('src/', cast(page_id % 5 AS string), '/pubspec.lock') ELSE concat('docs/', cast(page_id AS string), '.md') END AS path
        FROM pages""",
    "v_candidate": """
        SELECT concat('cand-', cast(p_partkey AS string)) AS candidate_id, p_partkey,
               concat('src/', CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END, '/', cast(p_partkey AS string), CASE p_partkey % 6 WHEN 0 THEN '.dart' WHEN 1 THEN '.ts' ELSE '.go' END, '#', split_part(p_name, ' ', 1), '.', split_part(p_name, ' ', 2)) AS entry_symbol_path,
               CASE p_size % 7 WHEN 0 THEN 'usecase_call' WHEN 1 THEN 'notifier_method' WHEN 2 THEN 'bloc_handler' WHEN 3 THEN 'route_callback' WHEN 4 THEN 'lifecycle_callback' WHEN 5 THEN 'state_mutation' ELSE 'other' END AS marker_kind,
               CASE p_size % 5 WHEN 0 THEN 'use_case_invocation' ELSE 'user_action' END AS trigger_class,
               CASE p_partkey % 8 WHEN 0 THEN 'the' WHEN 1 THEN 'der' WHEN 2 THEN 'que' WHEN 3 THEN 'thonre' WHEN 4 THEN 'Erou' WHEN 5 THEN '' WHEN 6 THEN 'les' ELSE 'Nobody' END AS class_name,
               concat(p_brand, '/', p_type) AS root_equivalence_key, p_name AS derived_name
        FROM part""",
    "v_name": """
        SELECT p_partkey, p_name, p_type, CASE p_partkey % 9 WHEN 0 THEN 'submitOrder' WHEN 1 THEN '_onItemAdded' WHEN 2 THEN 'onCheckoutPressed' WHEN 3 THEN 'URLLoader' WHEN 4 THEN 'onClick' WHEN 5 THEN '__$'
               WHEN 6 THEN concat('load_', replace(p_name, ' ', '$'), '2go') WHEN 7 THEN concat('__', replace(p_name, ' ', '_')) ELSE concat(p_type, 'Client') END AS name
        FROM part""",
    "v_manifest": """
        SELECT entry_symbol_path AS entry, CASE WHEN p_partkey % 11 = 0 THEN 'excluded' ELSE 'pinned' END AS rule, concat('Pinned ', derived_name) AS pin_name
        FROM v_candidate WHERE p_partkey % 11 = 0 OR p_partkey % 7 = 0""",
    "v_step": """
        SELECT l_orderkey AS flow, ordinal, kind, concat('Part', cast(l_partkey % 20 AS string), '.', CASE l_partkey % 5 WHEN 0 THEN 'loadOrders' WHEN 1 THEN '_onSubmitPressed' WHEN 2 THEN 'HTTPClient2Send' WHEN 3 THEN 'is_auth_valid' ELSE 'saveUserProfile' END) AS symbol,
               concat('lib/', CASE l_suppkey % 6 WHEN 0 THEN 'presentation' WHEN 1 THEN 'controllers' WHEN 2 THEN 'usecase' WHEN 3 THEN 'domain' WHEN 4 THEN 'data' ELSE 'misc' END, '/m', cast(l_suppkey % 10 AS string), '.dart') AS path,
               CASE l_suppkey % 6 WHEN 0 THEN 'Views' WHEN 1 THEN ' bloc ' WHEN 2 THEN 'app/services' WHEN 3 THEN 'entity' WHEN 4 THEN 'data' ELSE 'what' END AS raw_layer,
               l_suppkey % 3 AS invocation_id, 100 * ordinal AS byte_start, 100 * ordinal + cast(l_quantity AS bigint) AS byte_end,
               CASE WHEN l_discount > 0.08 THEN NULL ELSE concat('h', cast(l_partkey % 50 AS string)) END AS file_hash,
               CASE WHEN kind = 'branch' THEN 'x > 0' END AS guard_condition, CASE WHEN kind = 'external_effect' THEN concat(CASE l_partkey % 5 WHEN 0 THEN 'db:' WHEN 1 THEN 'queue:' WHEN 2 THEN 'fs:' WHEN 3 THEN 'api:' ELSE '' END, 'orders') END AS effect_target,
               CASE WHEN kind = 'mutation' THEN 'draft' END AS state_after, cast(l_quantity AS bigint) AS quantity, l_partkey AS partkey, l_suppkey AS suppkey
        FROM (SELECT *, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS bigint) AS ordinal,
                     CASE WHEN l_quantity < 6 THEN 'guard' WHEN l_quantity < 11 THEN 'branch' WHEN l_quantity < 17 THEN 'mutation' WHEN l_quantity < 27 THEN 'call' WHEN l_quantity < 31 THEN 'await' WHEN l_quantity < 35 THEN 'return' WHEN l_quantity < 40 THEN 'external_effect' WHEN l_quantity < 43 THEN 'failure' WHEN l_quantity < 46 THEN 'boundary' ELSE 'decision' END AS kind
              FROM lineitem) AS l""",
    "v_edge": """
        SELECT flow, cast(row_number() OVER (PARTITION BY flow ORDER BY step_ordinal, part) AS bigint) - 1 AS edge_idx, step_ordinal, target_ordinal, to_symbol, kind, resolution_status, partkey
        FROM (SELECT flow, 0 AS part, ordinal AS step_ordinal, CASE WHEN quantity % 9 = 0 THEN NULL ELSE ordinal + 1 END AS target_ordinal, lead(symbol) OVER (PARTITION BY flow ORDER BY ordinal) AS to_symbol,
                     CASE quantity % 8 WHEN 0 THEN 'resolved_cross_file' WHEN 1 THEN 'callback_argument' WHEN 2 THEN 'sequence' WHEN 3 THEN 'external' ELSE 'control_flow' END AS kind,
                     CASE quantity % 10 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'dynamic' ELSE 'resolved' END AS resolution_status, partkey, count(*) OVER (PARTITION BY flow) AS n, ordinal
              FROM v_step
              UNION ALL
              SELECT flow, 1 AS part, ordinal, ordinal + 2, lead(symbol, 2) OVER (PARTITION BY flow ORDER BY ordinal), 'control_flow', 'resolved', partkey, count(*) OVER (PARTITION BY flow), CASE WHEN kind IN ('branch', 'decision') THEN ordinal + 1 ELSE 1000000 END
              FROM v_step) AS e
        WHERE ordinal < n""",
    "v_call": """
        SELECT DISTINCT concat('c', cast(o_custkey AS string)) AS caller, concat('p', cast(l_partkey % 400 AS string)) AS callee, CASE WHEN l_partkey % 4 = 0 THEN 'implementation' ELSE 'call' END AS kind, CASE WHEN l_partkey % 9 = 0 THEN 'dynamic' ELSE 'verified' END AS status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL
        SELECT DISTINCT concat('p', cast(l_partkey % 400 AS string)), concat('s', cast(l_suppkey AS string)), 'call', CASE WHEN l_suppkey % 5 = 0 THEN 'dynamic' ELSE 'verified' END FROM lineitem
        UNION ALL
        SELECT concat('s', cast(s_suppkey AS string)), concat('n', cast(s_nationkey AS string)), 'call', 'verified' FROM supplier
        UNION ALL
        SELECT concat('n', cast(n_nationkey AS string)), concat('r', cast(n_regionkey AS string)), 'call', 'verified' FROM nation""",
    "v_call_all": """
        SELECT DISTINCT concat('c', cast(o_custkey AS string)) AS caller, concat('p', cast(l_partkey AS string)) AS callee, CASE WHEN l_partkey % 4 = 0 THEN 'implementation' ELSE 'call' END AS kind, CASE WHEN l_partkey % 9 = 0 THEN 'dynamic' ELSE 'verified' END AS status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL
        SELECT DISTINCT concat('p', cast(l_partkey AS string)), concat('s', cast(l_suppkey AS string)), 'call', CASE WHEN l_suppkey % 5 = 0 THEN 'dynamic' ELSE 'verified' END FROM lineitem
        UNION ALL
        SELECT concat('s', cast(s_suppkey AS string)), concat('n', cast(s_nationkey AS string)), 'call', 'verified' FROM supplier
        UNION ALL
        SELECT concat('n', cast(n_nationkey AS string)), concat('r', cast(n_regionkey AS string)), 'call', 'verified' FROM nation""",
    "v_gen_a": """
        SELECT concat('f/', cast(o_custkey % 20 AS string), '/', cast(o_orderkey AS string)) AS path, concat(o_orderpriority, cast(o_totalprice AS string)) AS content_id, o_orderkey AS k, o_orderstatus AS status
        FROM orders""",
    "v_gen_b": """
        SELECT CASE WHEN k % 19 = 0 THEN concat('moved/', path) ELSE path END AS path, CASE WHEN k % 10 = 0 THEN concat(content_id, '+') ELSE content_id END AS content_id, k, CASE WHEN k % 10 = 0 THEN 'X' ELSE status END AS status
        FROM v_gen_a WHERE k % 13 <> 0
        UNION ALL
        SELECT concat(path, '.copy'), concat(content_id, '.copy'), k + 10000000, status FROM v_gen_a WHERE k % 17 = 0""",
    "v_ledger": """
        SELECT event_id AS seq, ts, user_id AS subject, CASE event_type WHEN 'signup' THEN 'approve' WHEN 'purchase' THEN 'draft' WHEN 'error' THEN 'reject' ELSE 'note' END AS kind, concat(event_type, '-', cast(event_id AS string)) AS name
        FROM events""",
    "v_change": """
        SELECT event_id AS seq, concat('p/', cast(user_id AS string)) AS path, cast(floor(value) AS bigint) AS version, CASE event_id % 4 WHEN 0 THEN 'watcher' WHEN 1 THEN 'editor' WHEN 2 THEN 'agent' ELSE 'other' END AS source, event_type AS kind, ts
        FROM events""",
    "v_publish": """
        SELECT event_id % 20 AS key, event_id AS seq, concat('g', cast(event_id AS string)) AS generation, CASE WHEN event_id < 20 THEN '' WHEN event_id % 7 = 0 THEN '*' WHEN event_id % 3 = 0 THEN concat('g', cast(event_id - 60 AS string)) ELSE concat('g', cast(event_id - 20 AS string)) END AS expected
        FROM events""",
    "v_turn": """
        SELECT conv_id AS flow, turn AS ordinal, role AS kind, text FROM conversations""",
    "v_criterion": """
        SELECT item_id AS criterion_id, text FROM benchmark""",
}


def _used(sql: str) -> list[str]:
    words = set(re.findall(r"\b\w+\b", sql))
    return [v for v in VIEWS if v in words]


def closure(names: list[str]) -> list[str]:
    """The views and those they use, each after what it uses."""
    out: list[str] = []

    def add(name: str) -> None:
        for inner in _used(VIEWS[name]):
            add(inner)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def load(spark: SparkSession, sf_dir: str, names: list[str], given: dict[str, DataFrame] | None = None, keep: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Tables and views by name, over the tables ``given`` and else the Parquet tables of ``sf_dir``; the views of ``keep`` are written once and read from there."""
    views = closure([n for n in names if n in VIEWS])
    text = " ".join(VIEWS[v] for v in views)
    found = {}
    for t in TABLES:
        if t in names or re.search(rf"\b{t}\b", text):
            found[t] = given[t] if given and t in given else spark.read.parquet(f"{sf_dir}/{t}.parquet")
            found[t].createOrReplaceTempView(t)
    for v in views:
        found[v] = save(spark.sql(VIEWS[v])) if v in keep else spark.sql(VIEWS[v])
        found[v].createOrReplaceTempView(v)
    return found


def with_views(names: list[str], sql: str) -> str:
    """``sql`` after a WITH clause for the views it names."""
    views = closure([n for n in names if n in VIEWS])
    if not views:
        return sql
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views)
    body = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {head},\n{re.sub(r'^WITH\s+RECURSIVE\s+', '', body, flags=re.I)}"
    if re.match(r"WITH\b", body, re.I):
        return f"WITH {head},\n{re.sub(r'^WITH\s+', '', body, flags=re.I)}"
    return f"WITH {head}\n{body}"
