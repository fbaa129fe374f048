"""The registered queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.edges import edge_text, jittered, label_text, vertex_text
from ..operators import prepare, rounds
from ..operators.components import connected_components
from ..operators.forest import forest_weight, minimum_spanning_forest
from ..sources.edge_list import generate_graph
from ..sources.run_log import parse_run_log, run_log_lines
from .graphs import GRAPH_SQL, GRAPHS, SALES_SQL, nation_sales, nation_trade, part_supplier, part_supplier_sparse, supplier_nearest, table
from .metrics import mean_times, scaling_report

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, name: str = "") -> Callable[[Query], Query]:
    """Registers a function under its own or the given name."""

    def add(f: Query) -> Query:
        _queries[name or f.__name__] = f
        if sql is not None:
            _sql[name or f.__name__] = sql
        return f

    return add


def kruskal_sql(src: str, ends: str) -> str:
    """Kruskal's algorithm over the edges of `src`; `ends` is the last select, over k (edges), st (steps) and n (vertices)."""
    return f"""
with recursive e as materialized ({src}),
n as materialized (select id, row_number() over (order by id) as ix from (select u as id from e union select v from e)),
k as materialized (select row_number() over (order by w, u, v) as r, u, v, w, a.ix as ui, b.ix as vi from e join n a on a.id = u join n b on b.id = v),
st as (select 0::bigint as r, (select list(ix order by ix) from n) as lab, false as keep
  union all
  select k.r, case when lab[ui] = lab[vi] then lab else list_transform(lab, lambda x: case when x = greatest(lab[ui], lab[vi]) then least(lab[ui], lab[vi]) else x end) end, lab[ui] <> lab[vi]
  from st join k on k.r = st.r + 1)
{ends}"""


def forest_sql(graph: str) -> str:
    return kruskal_sql(GRAPH_SQL[graph], "select u, v, cast(w as double) as w from st join k using (r) where keep")


def labels_sql(src: str) -> str:
    return kruskal_sql(src, "select n.id as vertex, m.id as component from (select lab from st order by r desc limit 1) s, n join n m on m.ix = s.lab[n.ix]")


CLEAN_SQL = f"select least(u, v) as u, greatest(u, v) as v, cast(w as double) as w from ({SALES_SQL}) where u <> v"
#: The edges that are the lightest of one of their ends.
CHOSEN_SQL = """select u, v, w from (
  select u, v, w, row_number() over (partition by vertex order by w, u, v) as rn
  from (select u as vertex, u, v, w from g union all select v, u, v, w from g)) where rn = 1 group by all"""


def chosen_sql(graph: str) -> str:
    return CHOSEN_SQL.replace("from g", f"from ({GRAPH_SQL[graph]})")


def _double(df: DataFrame) -> DataFrame:
    return df.withColumn("w", F.col("w").cast("double"))


@query(CLEAN_SQL)
def edges_clean(spark, sf_dir):
    return _double(prepare.clean_edges(nation_sales(spark, sf_dir)))


@query(f"with c as ({CLEAN_SQL}) select u as src, v as dst, w from c union all select v, u, w from c")
def edges_symmetric(spark, sf_dir):
    return prepare.symmetric_edges(edges_clean(spark, sf_dir))


@query(f"select u - 1 as u, v - 1 as v, cast(w as double) as w from ({GRAPH_SQL['part_supplier']})")
def edges_rebased(spark, sf_dir):
    return _double(prepare.rebased_edges(part_supplier(spark, sf_dir), 1))


@query(f"select u, v, cast(w as double) as w from ({GRAPH_SQL['part_supplier']}) order by u, v")
def edges_sorted(spark, sf_dir):
    return _double(prepare.sorted_edges(part_supplier(spark, sf_dir)))


@query(f"select u, v, min(w) as w from ({CLEAN_SQL}) group by 1, 2")
def edges_dedupe_min(spark, sf_dir):
    return _double(prepare.prepare_edges(nation_sales(spark, sf_dir)))


@query(f"""select u, v, w from (select least(u, v) as u, greatest(u, v) as v, cast(w as double) as w, row_number() over (partition by least(u, v), greatest(u, v) order by l_orderkey, l_linenumber, w) as rn
from ({SALES_SQL}) where u <> v) where rn = 1""")
def edges_dedupe_first(spark, sf_dir):
    return _double(prepare.prepare_edges(nation_sales(spark, sf_dir), dedupe="first", order_col="ord"))


@query(f"select u as vertex from ({GRAPH_SQL['part_supplier']}) union select v from ({GRAPH_SQL['part_supplier']})")
def vertices(spark, sf_dir):
    return prepare.vertices_of(part_supplier(spark, sf_dir))


@query(" union all ".join(f"select '{g}' as graph, (select count(*) from (select u from ({s}) union select v from ({s}))) as vertices, (select count(*) from ({s})) as edges, 2 * (select count(*) from ({s})) as directed_edges" for g, s in GRAPH_SQL.items()))
def graph_counts(spark, sf_dir):
    out = None
    for name, graph in GRAPHS.items():
        row = prepare.graph_counts(graph(spark, sf_dir)).select(F.lit(name).alias("graph"), "vertices", "edges", "directed_edges")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"select 'Edge from: ' || u || ' to: ' || v || ' weight: ' || cast(w as decimal(18,2)) as line from ({GRAPH_SQL['nation_trade']})", name="edge_text")
def edge_text_lines(spark, sf_dir):
    return nation_trade(spark, sf_dir).select(edge_text(F.col("u"), F.col("v"), F.col("w").cast("decimal(18,2)")).alias("line"))


@query(f"""with g as ({GRAPH_SQL['part_supplier']}) select vertex, u, v, cast(w as double) as w from (
  select vertex, u, v, w, row_number() over (partition by vertex order by w, u, v) as rn
  from (select u as vertex, u, v, w from g union all select v, u, v, w from g)) where rn = 1""")
def min_edge_per_vertex(spark, sf_dir):
    return _double(rounds.min_edge_per_vertex(part_supplier(spark, sf_dir)))


@query(labels_sql(chosen_sql("part_supplier")))
def contract_round1(spark, sf_dir):
    return rounds.first_round(part_supplier(spark, sf_dir))


@query(f"with labels as ({labels_sql(chosen_sql('part_supplier'))}), g as ({GRAPH_SQL['part_supplier']}) select u, v, cast(w as double) as w, a.component as cu, b.component as cv from g join labels a on a.vertex = u join labels b on b.vertex = v where a.component <> b.component")
def filter_edges_round1(spark, sf_dir):
    edges = part_supplier(spark, sf_dir)
    return _double(rounds.filter_edges(edges, rounds.first_round(edges)))


@query(f"select distinct component from ({labels_sql(chosen_sql('part_supplier'))})")
def component_roots_round1(spark, sf_dir):
    return rounds.component_roots(contract_round1(spark, sf_dir))


def _forest(graph: Query) -> Query:
    return lambda spark, sf_dir: _double(minimum_spanning_forest(graph(spark, sf_dir)).edges.select("u", "v", "w"))


for _name, _graph, _sql_of in (("nation", nation_trade, "nation_trade"), ("supplier", supplier_nearest, "supplier_balance"), ("part_supplier", part_supplier, "part_supplier"), ("sparse", part_supplier_sparse, "part_supplier_sparse")):
    _queries[f"spanning_forest_{_name}"] = _forest(_graph)
    _sql[f"spanning_forest_{_name}"] = forest_sql(_sql_of)


# Over the whole graph of parts and suppliers, and (`_sparse`) over its cheap edges, which leave it in several components.
for _name, _graph in (("", part_supplier), ("_sparse", part_supplier_sparse)):
    _src = GRAPH_SQL[_graph.__name__]

    @query(kruskal_sql(_src, "select count(*) as edges, cast(sum(w) as double) as weight from st join k using (r) where keep"), name=f"forest_weight{_name}")
    def forest_weight_of(spark, sf_dir, graph=_graph):
        return forest_weight(minimum_spanning_forest(graph(spark, sf_dir)).edges)

    @query(labels_sql(_src), name=f"components{_name}")
    def components(spark, sf_dir, graph=_graph):
        return connected_components(graph(spark, sf_dir))

    @query(f"select component, count(*) as size from ({labels_sql(_src)}) group by 1", name=f"component_sizes{_name}")
    def component_sizes(spark, sf_dir, graph=_graph):
        return minimum_spanning_forest(graph(spark, sf_dir)).labels.groupBy("component").agg(F.count("*").alias("size"))

    @query(f"""with labels as ({labels_sql(_src)}), pairs as (select distinct l_partkey::bigint as a, (1000000 + l_suppkey)::bigint as b from lineitem)
select a, b, x.component = y.component as connected from pairs join labels x on x.vertex = a join labels y on y.vertex = b""", name=f"connected_pairs{_name}")
    def connected_pairs(spark, sf_dir, graph=_graph):
        labels = connected_components(graph(spark, sf_dir))
        pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("bigint").alias("a"), (F.col("l_suppkey") + 1_000_000).cast("bigint").alias("b")).distinct()
        one = pairs.join(labels.select(F.col("vertex").alias("a"), F.col("component").alias("x")), "a")
        return one.join(labels.select(F.col("vertex").alias("b"), F.col("component").alias("y")), "b").select("a", "b", (F.col("x") == F.col("y")).alias("connected"))


@query()
def round_trace(spark, sf_dir):
    return minimum_spanning_forest(part_supplier(spark, sf_dir)).trace


@query(f"""with g as ({GRAPH_SQL['part_supplier']}) select 1 as round, (select count(*) from g) as live_edges, (select count(*) from (select u from g union select v from g)) as components,
(select count(*) from ({chosen_sql('part_supplier')})) as chosen_edges""")
def round_trace_first(spark, sf_dir):
    """The trace's first row, which SQL can say without rounds."""
    return round_trace(spark, sf_dir).filter("round = 1")


@query(f"with g as ({GRAPH_SQL['nation_trade']}) select 'Node ' || id as line from (select u as id from g union select v from g)")
def node_text(spark, sf_dir):
    return prepare.vertices_of(nation_trade(spark, sf_dir)).select(vertex_text(F.col("vertex")).alias("line"))


@query(f"select vertex || ': component=' || component as line from ({labels_sql(GRAPH_SQL['part_supplier_sparse'])})", name="label_text")
def label_text_lines(spark, sf_dir):
    return connected_components(part_supplier_sparse(spark, sf_dir)).select(label_text(F.col("vertex"), F.col("component")).alias("line"))


RUNS_SQL = """select case event_id % 3 when 0 then 'sequential' when 1 then 'pool' else 'farm' end as engine,
  case when event_id % 3 > 0 then cast(user_id % 8 + 1 as integer) end as workers, cast(event_id % 5 + 1 as integer) as iters, cast(round(value * 1000) as bigint) as usec from events"""
LINES_SQL = f"""select engine, case when workers is null then engine || '; iters: ' || iters || '; time: ' || usec || ' usec' else 'workers: ' || workers || '; iters: ' || iters || '; time ' || usec || ' usec' end as line from ({RUNS_SQL})"""
PARSED_SQL = f"""select engine, coalesce(try_cast(regexp_extract(line, 'workers: (\\d+)', 1) as integer), 1) as workers, cast(regexp_extract(line, 'iters: (\\d+)', 1) as integer) as iters, cast(regexp_extract(line, 'time:? (\\d+) usec', 1) as bigint) as usec from ({LINES_SQL})"""
MEANS_SQL = f"select engine, workers, count(*) as n, sum(usec) / count(*) as mean_usec, stddev_samp(usec) as std_usec from ({PARSED_SQL}) group by 1, 2"


def runs(spark, sf_dir):
    kind = F.col("event_id") % 3
    return table(spark, sf_dir, "events").select(
        F.when(kind == 0, "sequential").when(kind == 1, "pool").otherwise("farm").alias("engine"),
        F.when(kind > 0, (F.col("user_id") % 8 + 1).cast("int")).alias("workers"),
        (F.col("event_id") % 5 + 1).cast("int").alias("iters"),
        F.round(F.col("value") * 1000).cast("bigint").alias("usec"),
    )


@query(LINES_SQL)
def run_log_text(spark, sf_dir):
    return run_log_lines(runs(spark, sf_dir))


@query(PARSED_SQL)
def run_log_parse(spark, sf_dir):
    return parse_run_log(run_log_lines(runs(spark, sf_dir)))


@query(f"select engine, workers, n, round(mean_usec, 3) as mean_usec, round(std_usec, 3) as std_usec from ({MEANS_SQL})")
def run_log_mean(spark, sf_dir):
    means = mean_times(run_log_parse(spark, sf_dir))
    return means.select("engine", "workers", "n", F.round("mean_usec", 3).alias("mean_usec"), F.round("std_usec", 3).alias("std_usec"))


@query(f"""with p as ({PARSED_SQL}), m as ({MEANS_SQL}), b as (select sum(usec) / count(*) as base from p where engine = 'sequential')
select engine, workers, round(mean_usec, 3) as mean_usec, round(base / mean_usec, 6) as speedup,
  round(first_value(mean_usec) over (partition by engine order by workers) / mean_usec, 6) as scalability, round(base / mean_usec / workers, 6) as efficiency
from m, b where engine <> 'sequential'""", name="scaling_report")
def scaling_table(spark, sf_dir):
    report = scaling_report(run_log_parse(spark, sf_dir), "sequential")
    return report.select("engine", "workers", F.round("mean_usec", 3).alias("mean_usec"), *(F.round(c, 6).alias(c) for c in ("speedup", "scalability", "efficiency")))


@query()
def random_graph(spark, sf_dir):
    return generate_graph(spark, 1000, 5000, seed=42)


@query("select 5000 as edges, 5000 as pairs, true as in_order, true as in_range, true as spread")
def random_graph_facts(spark, sf_dir):
    """What every draw has: so many different edges, the smaller end first, ids and weights in their ranges and all over them."""
    w = F.col("w")
    facts = random_graph(spark, sf_dir).agg(
        F.count("*").alias("edges"), F.count_distinct("u", "v").alias("pairs"), F.bool_and(F.col("u") < F.col("v")).alias("in_order"),
        F.bool_and((F.col("u") >= 0) & (F.col("v") < 1000) & (w >= 1) & (w < 10)).alias("in_range"), ((F.min("u") < 20) & (F.max("v") > 980) & (F.min(w) < 1.2) & (F.max(w) > 9.8) & F.avg(w).between(5.2, 5.8)).alias("spread"),
    )
    return facts


@query()
def jittered_weights(spark, sf_dir):
    return part_supplier(spark, sf_dir).select("u", "v", jittered(F.col("w").cast("double"), 42).alias("w"))


@query(f"select u, v, true as moved_by_less_than_one from ({GRAPH_SQL['part_supplier']})")
def jittered_weights_facts(spark, sf_dir):
    one, other = part_supplier(spark, sf_dir).select("u", "v", F.col("w").cast("double").alias("was")), jittered_weights(spark, sf_dir)
    return one.join(other, ["u", "v"]).select("u", "v", (F.abs(F.col("w") - F.col("was")) <= 1).alias("moved_by_less_than_one"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
