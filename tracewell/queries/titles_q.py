"""Queries over titles, markers, projects and effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import titles as T
from tracewell.operators import meaning as N
from tracewell.operators.store import save
from tracewell.queries.registry import query


@query("derive_title", "v_step", """
SELECT DISTINCT symbol, CASE split_part(symbol, '.', 2) WHEN 'loadOrders' THEN '주문 목록을 불러온다' WHEN '_onSubmitPressed' THEN '제출한다' WHEN 'HTTPClient2Send' THEN '전송한다' WHEN 'is_auth_valid' THEN '인증한다' ELSE '사용자를 저장한다' END AS title FROM v_step""")
def derive_title(v):
    return v["v_step"].select("symbol").distinct().select("symbol", T.derive_title(F.split_part("symbol", F.lit("."), F.lit(2))).alias("title"))


@query("segment_title", "v_step", "SELECT flow, ordinal, CASE WHEN partkey % 3 = 0 THEN 'order' || ordinal ELSE symbol END AS title FROM v_step")
def segment_title(v):
    target = F.when(F.expr("partkey % 3 = 0"), F.concat(F.lit("final order"), F.col("ordinal").cast("string"), F.lit(" = load()")))
    return v["v_step"].select("flow", "ordinal", T.segment_title(F.col("symbol"), target).alias("title"))


@query("marker_web_file", "v_step pages", """
SELECT flow, ordinal, CASE WHEN split_part(symbol, '.', 2) LIKE 'get%' THEN NULL WHEN page_id % 3 = 0 OR split_part(symbol, '.', 2) = 'loadOrders' THEN 'lifecycle_callback' END AS marker FROM v_step JOIN pages ON page_id = partkey % 50""")
def marker_web_file(v):
    """A file's directive makes its functions entries, but those named like accessors."""
    text = F.concat(F.expr("if(page_id % 3 = 0, '\"use server\"\\n', '')"), F.regexp_replace("html", "use server", ""))
    rows = v["v_step"].join(v["pages"].select("page_id", text.alias("file")), F.expr("page_id = partkey % 50"))
    return rows.select("flow", "ordinal", T.marker_web(F.lit(None), F.col("symbol"), F.lit(None), F.col("file"))["marker"].alias("marker"))


@query("marker_web", "v_step", """
SELECT DISTINCT symbol, CASE split_part(symbol, '.', 2) WHEN 'loadOrders' THEN 'lifecycle_callback' END AS marker FROM v_step""")
def marker_web(v):
    return v["v_step"].select("symbol").distinct().select("symbol", T.marker_web(F.lit(None), F.col("symbol"), F.lit(None))["marker"].alias("marker"))


# Class, method, body and the marker they give, one row for each rule and its exceptions.
_MOBILE = [
    ("HomePage", "didChangeAppLifecycleState", "", "lifecycle_callback"), ("CartNotifier", "add", "state = x; notifyListeners();", "state_mutation"), ("CartNotifier", "add", "state = x;", "notifier_method"), ("LoginUseCase", "run", "", "usecase_call"), ("LoginUseCase", "_run", "", None), ("OrderBloc", "_onAdd", "", "bloc_handler"),
    ("OrderController", "build", "", "notifier_method"), ("OrderController", "save", "", "notifier_method"), ("HomePage", "open", "deepLink", "route_callback"), ("HomePage", "open", "queryParameters; context.go('/x')", "route_callback"), ("HomePage", "open", "Navigator.of(context)", "route_callback"), ("HomePage", "onSavePressed", "", "route_callback"),
    ("HomePage", "build", "", None), ("OrderBloc", "add", "", "notifier_method"), ("NetProbe", "check", "ping();", "usecase_call"), ("NetProbe", "check", " ", None), ("AuthInterceptor", "run", "x", "lifecycle_callback"), ("UserRepository", "load", "x", None), ("", "onBackgroundMessage", "", "lifecycle_callback"), ("", "main", "appRouter.push(x)", None), ("", "open", "deep_link", "route_callback"),
]
_MOBILE_SQL = ", ".join(f"({i}, {'NULL' if marker is None else repr(marker)})" for i, (*_, marker) in enumerate(_MOBILE))


@query("marker_mobile", "part", f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND i IN (14, 16) THEN NULL ELSE marker END AS marker FROM part JOIN (VALUES {_MOBILE_SQL}) m(i, marker) ON i = p_partkey // 2 % {len(_MOBILE)}")
def marker_mobile(v):
    """Rows with an even key stand in a test folder."""
    case = F.get(F.array(*[F.struct(F.lit(c).alias("scope"), F.lit(n).alias("name"), F.lit(b).alias("body")) for c, n, b, _ in _MOBILE]), F.expr(f"int(p_partkey div 2 % {len(_MOBILE)})"))
    rows = v["part"].select("p_partkey", case.alias("c"), F.expr("if(p_partkey % 2 = 0, 'app/test/a.dart', 'lib/a.dart')").alias("path"))
    return rows.select("p_partkey", T.marker_mobile(F.col("c.scope"), F.col("c.name"), F.col("c.body"), F.col("path"), ["riverpod", "bloc"])["marker"].alias("marker"))


@query("detect_arch", "orders", """
SELECT o_custkey AS repo_id, CASE WHEN bool_or(o_orderkey % 5 = 0) AND bool_or(o_orderkey % 5 = 1) THEN 'feature_sliced_design' WHEN bool_or(o_orderkey % 5 = 2) THEN 'standard_react_spa' WHEN bool_or(o_orderkey % 5 = 3) THEN 'clean_architecture' WHEN bool_or(o_orderkey % 5 IN (0, 1)) THEN 'generic_frontend' ELSE 'clean_architecture' END AS pattern
FROM orders GROUP BY 1""")
def detect_arch(v):
    path = F.expr("case o_orderkey % 5 when 0 then concat('src/features/', o_orderkey) when 1 then concat('src/entities/', o_orderkey) when 2 then 'package.json' when 3 then 'go.mod' else 'README' end")
    rows = v["orders"].select(F.col("o_custkey").alias("repo_id"), path.alias("path"), F.lit('{"dependencies": {"vue" : "3"}}').alias("content"))
    return N.detect_architecture(rows)


@query("reanchor", "v_step", """
SELECT flow, ordinal, CASE WHEN suppkey % 6 = 5 THEN 'unknown_boundary' WHEN partkey % 4 = 0 THEN 'verified' WHEN partkey % 4 = 1 THEN 'adjusted' ELSE 'unknown_boundary' END AS outcome FROM v_step""")
def reanchor(v):
    steps = v["v_step"].withColumn("key", F.concat("path", F.lit("#"), F.col("flow").cast("string"), F.lit("#"), F.col("ordinal").cast("string")))
    name = F.split_part("symbol", F.lit("."), F.lit(2))
    docs = steps.filter("suppkey % 6 <> 5").select(F.col("key").alias("path"), F.concat(F.expr("case partkey % 4 when 0 then 'span here ' when 1 then 'x\\nfunc ' else 'let ' end"), name, F.lit("() {}\n")).alias("content"))
    anchors = steps.select("flow", "ordinal", F.col("key").alias("path"), "symbol", F.lit("span here").alias("span"))
    return N.reanchor(anchors, docs).select("flow", "ordinal", "outcome")


@query("impact_effects", "v_call part")
def impact_effects(v):
    """State changes and effects within two calls of every customer."""
    edges = save(v["v_call"].groupBy("caller", "callee").agg(F.max("status").alias("status")).withColumn("idx", F.hash("callee")))
    roots = edges.filter("caller like 'c%'").select(F.col("caller").alias("root"), F.col("caller").alias("node")).distinct()
    steps = v["part"].select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.when(F.expr("p_size % 3 = 0"), F.concat(F.lit("db:"), "p_brand")).alias("effect"), F.when(F.expr("p_size % 3 = 1"), F.col("p_type")).alias("state"))
    return N.impact_effects(roots, edges, steps, 2, 40)
