"""Queries that put the remaining operators to work on the tables of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeledger.functions.measures import clamp_u32
from treeledger.operators import gate, intervals, similarity
from treeledger.operators.select import merge_gaps
from treeledger.sources import git, scan
from treeledger.sources.tables import table

Q = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query(
    "q09_worst_order",
    "with r as (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) select o_custkey, o_orderkey, o_totalprice from r where k = 1",
)
def q09(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("w"))
    return best.select("o_custkey", "w.o_orderkey", "w.o_totalprice")


@query("q10_top_orders", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def q10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


PATH = r"regexp_extract(url, '^[^:]*://[^/?#]*/?([^?#]*)', 1)"


def url_path(url):
    return F.regexp_extract(url, r"^[^:]*://[^/?#]*/?([^?#]*)", 1)


@query(
    "q11_path_filter",
    f"select page_id, {PATH} as path, not list_has_any(string_split({PATH}, '/')[1:-2], ['de', 'node_modules', 'vendor', 'test']) as kept from pages",
)
def q11(spark: SparkSession, d: str) -> DataFrame:
    path = url_path(F.col("url"))
    rows = table(spark, d, "pages").select("page_id", path.alias("path"))
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return rows.select("page_id", "path", (~F.arrays_overlap(folders, F.array(*map(F.lit, ("de", "node_modules", "vendor", "test"))))).alias("kept"))


FILES_SQL = "files as (select p_partkey as id, 'src/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || case p_partkey % 6 when 0 then '.ts' when 1 then '.py' when 2 then '.d.ts' when 3 then '.C' when 4 then '_test.go' else '.txt' end as path from part)"


def part_files(spark: SparkSession, d: str) -> DataFrame:
    ends = F.create_map(*[F.lit(x) for kv in {0: ".ts", 1: ".py", 2: ".d.ts", 3: ".C", 4: "_test.go", 5: ".txt"}.items() for x in kv])
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), ends[(F.col("p_partkey") % 6).cast("int")])
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), path.alias("path"))


@query(
    "q12_extension_language",
    f"with {FILES_SQL} select id, case when path like '%.d.ts' then null when path like '%.ts' then 'typescript' when path like '%.py' then 'python' when path like '%.C' then 'cpp' when path like '%.go' then 'go' end as language from files",
)
def q12(spark: SparkSession, d: str) -> DataFrame:
    return part_files(spark, d).select("id", scan.language_of(F.col("path")).alias("language"))


@query("q13_test_name_filter", f"with {FILES_SQL} select id from files where not path like '%\\_test.go' escape '\\' and not path like '%.d.ts' and not path like '%.txt'")
def q13(spark: SparkSession, d: str) -> DataFrame:
    return part_files(spark, d).where(scan.is_scanned(F.col("path"))).select("id")


SPANS_SQL = "spans as (select event_id as id, user_id, (epoch_us(ts) // 1000000)::bigint as start, (epoch_us(ts) // 1000000)::bigint + 1800 as stop from events)"


def spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("start")).withColumn("stop", F.col("start") + 1800)


@query(
    "q34_interval_union",
    f"""with {SPANS_SQL}, r as (select *, max(stop) over (partition by user_id order by start, stop rows between unbounded preceding and 1 preceding) as reach from spans),
n as (select *, sum(case when reach is null or start > reach then 1 else 0 end) over (partition by user_id order by start, stop rows unbounded preceding) as island from r)
select user_id, min(start) as start, max(stop) as stop from n group by user_id, island""",
)
def q34(spark: SparkSession, d: str) -> DataFrame:
    return intervals.union_intervals(spans(spark, d), "user_id")


@query(
    "q35_interval_overlap",
    f"with {SPANS_SQL} select a.user_id, a.id as a, b.id as b from spans a join spans b on a.user_id = b.user_id and a.id < b.id and a.start < b.stop and b.start < a.stop",
)
def q35(spark: SparkSession, d: str) -> DataFrame:
    rows = spans(spark, d)
    return intervals.overlapping(rows, rows, "user_id", 3600).where("a < b")


@query("q26_gap_merge")
def q26(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    rows = spans(spark, d).select("user_id", "id", "start", "stop")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        pairs = lambda odd: [(r.start, r.start + 60) for r in frame.itertuples() if r.id % 2 == odd]
        got = merge_gaps(pairs(0), pairs(1), 86400)
        return pd.DataFrame({"user_id": [frame["user_id"].iloc[0]] * len(got), "start": [a for a, _ in got], "stop": [b for _, b in got]})

    return rows.groupBy("user_id").applyInPandas(run, "user_id bigint, start bigint, stop bigint")


BASE_HEAD_SQL = """base as (select o_orderkey as id, o_custkey % 50 as file, o_orderpriority as name, o_orderkey % 7 as arity from orders where o_orderkey % 3 <> 0),
head as (select o_orderkey as id, o_custkey % 50 as file, o_orderpriority as name, o_orderkey % 5 as arity from orders where o_orderkey % 3 <> 1),
m1 as (select b.id as base_id, h.id as head_id from (select file, name, arity, min(id) as id from base group by all having count(*) = 1) b join (select file, name, arity, min(id) as id from head group by all having count(*) = 1) h using (file, name, arity)),
rb as (select * from base where id not in (select base_id from m1)), rh as (select * from head where id not in (select head_id from m1)),
m2 as (select b.id as base_id, h.id as head_id from (select file, name, min(id) as id from rb group by all having count(*) = 1) b join (select file, name, min(id) as id from rh group by all having count(*) = 1) h using (file, name)),
matches as (select * from m1 union all select * from m2)"""


def base_head(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("file"), F.col("o_orderpriority").alias("name"))
    return rows.where("id % 3 <> 0").withColumn("arity", F.col("id") % 7), rows.where("id % 3 <> 1").withColumn("arity", F.col("id") % 5)


@query("q41_key_matching", f"with {BASE_HEAD_SQL} select * from matches")
def q41(spark: SparkSession, d: str) -> DataFrame:
    return gate.match_rounds(*base_head(spark, d))


@query("q42_unmatched", f"with {BASE_HEAD_SQL} select file, count(*) as n from head where id not in (select head_id from matches) group by file")
def q42(spark: SparkSession, d: str) -> DataFrame:
    base, head = base_head(spark, d)
    return gate.unmatched(head, gate.match_rounds(base, head), "head_id").groupBy("file").agg(F.count("*").alias("n"))


def name_pairs(spark: SparkSession, d: str, least: int) -> DataFrame:
    letters = lambda t, c: table(spark, d, t).select(F.col(c).alias("id"), F.lit(0).alias("bucket"), F.split(c, "").alias("s"))
    return similarity.similar_pairs(letters("nation", "n_name"), letters("nation", "n_name"), least).where("a <> b")


@query("q43_similarity_join")
def q43(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d, 40)


@query("q44_split_evidence")
def q44(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d, 30).groupBy("a").agg(F.max("percent").alias("percent"))


@query("q45_matching")
def q45(spark: SparkSession, d: str) -> DataFrame:
    return similarity.match_groups(name_pairs(spark, d, 30).withColumn("bucket", F.lit(0)))


PAIRS_SQL = """pairs as (select o_custkey as id,
  count(*) filter (o_orderkey % 2 = 0) as base_cognitive, count(*) filter (o_orderkey % 2 = 1) as head_cognitive,
  sum(case when o_orderkey % 2 = 0 then length(o_orderpriority) else 0 end)::bigint as base_ncss, sum(case when o_orderkey % 2 = 1 then length(o_orderpriority) else 0 end)::bigint as head_ncss,
  count(distinct o_orderpriority) filter (o_orderkey % 2 = 0) as base_nesting, count(distinct o_orderpriority) filter (o_orderkey % 2 = 1) as head_nesting,
  count(distinct o_orderstatus) filter (o_orderkey % 2 = 0) * 10 as base_dep_degree, count(distinct o_orderstatus) filter (o_orderkey % 2 = 1) * 10 as head_dep_degree,
  (sum(case when o_orderkey % 2 = 0 then length(o_orderpriority) else 0 end) * 20)::double as base_volume, (sum(case when o_orderkey % 2 = 1 then length(o_orderpriority) else 0 end) * 20)::double as head_volume
  from orders group by o_custkey)"""


def gate_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    cols = []
    for i, side in enumerate(("base", "head")):
        mine = F.col("o_orderkey") % 2 == i
        size = F.sum(F.when(mine, F.length("o_orderpriority")).otherwise(0))
        cols += [
            F.count_if(mine).alias(f"{side}_cognitive"), size.alias(f"{side}_ncss"), F.count_distinct(F.when(mine, F.col("o_orderpriority"))).alias(f"{side}_nesting"),
            (F.count_distinct(F.when(mine, F.col("o_orderstatus"))) * 10).alias(f"{side}_dep_degree"), (size * 20).cast("double").alias(f"{side}_volume"),
        ]
    return rows.groupBy(F.col("o_custkey").alias("id")).agg(*cols)


RATCHET_SQL = f"""with {PAIRS_SQL}, v as (
  select id, 'cognitive complexity' as metric, base_cognitive::double as base_value, head_cognitive::double as head_value, base_cognitive + 2.0::double as allowed from pairs
  union all select id, 'NCSS', base_ncss, head_ncss, base_ncss + 5 from pairs
  union all select id, 'max nesting depth', base_nesting, head_nesting, base_nesting + 1 from pairs
  union all select id, 'DepDegree', base_dep_degree, head_dep_degree, base_dep_degree + 10 from pairs
  union all select id, 'Halstead volume', base_volume, head_volume, base_volume + greatest(150, base_volume * 0.25::double) from pairs)"""


@query("q46_ratchet_violations", f"{RATCHET_SQL} select * from v where head_value > allowed")
def q46(spark: SparkSession, d: str) -> DataFrame:
    return gate.ratchet_violations(gate_pairs(spark, d), gate.ratchets(), ["id"])


@query(
    "q47_new_limits",
    f"with {PAIRS_SQL} select id, metric, head_value, allowed from (select id, 'cognitive complexity' as metric, head_cognitive::double as head_value, 15.0::double as allowed from pairs where base_cognitive = 0 union all select id, 'NCSS', head_ncss, 60 from pairs where base_cognitive = 0 union all select id, 'max nesting depth', head_nesting, 4 from pairs where base_cognitive = 0) where head_value > allowed",
)
def q47(spark: SparkSession, d: str) -> DataFrame:
    limits = gate.NewLimits()
    new = gate_pairs(spark, d).where("base_cognitive = 0")
    return gate.limit_violations(new, [("cognitive complexity", "head_cognitive", limits.cognitive), ("NCSS", "head_ncss", limits.ncss), ("max nesting depth", "head_nesting", limits.nesting)], ["id"])


@query(
    "q48_file_backstops",
    f"""with {PAIRS_SQL}, f as (select id as file, 'file max cognitive complexity' as metric, base_cognitive::double as base_value, head_cognitive::double as head_value, base_cognitive + 2.0::double as allowed from pairs where id % 2 = 0
union all select id, 'file NCSS', base_ncss, head_ncss, base_ncss + 20 from pairs where id % 2 = 0)
select * from f where head_value > allowed and not (metric = 'file max cognitive complexity' and head_value > 5)""",
)
def q48(spark: SparkSession, d: str) -> DataFrame:
    pairs = gate_pairs(spark, d)
    files = pairs.select(F.col("id").alias("file"), (F.col("id") % 2 == 0).alias("split"), F.col("base_cognitive").alias("base_max_cognitive"), F.col("head_cognitive").alias("head_max_cognitive"), "base_ncss", "head_ncss")
    reported = pairs.where("head_cognitive > 5").select(F.col("id").alias("file"), F.col("head_cognitive").alias("head_value"))
    return gate.file_backstops(files, reported)


@query(
    "q49_duplication_gate",
    """with n as (select source, lang, count(*) - count(distinct text) as dup from documents group by 1, 2),
p as (select source, max(case when lang = 'en' then dup end) as head, coalesce(max(case when lang = 'de' then dup end), 0) as base from n group by source)
select source, base, head from p where head > base""",
)
def q49(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "documents").groupBy("source", "lang", "text").agg(F.count("*").alias("n"))
    dup = each.groupBy("source", "lang").agg((F.sum("n") - F.count("*")).alias("dup"))
    side = lambda x: F.max(F.when(F.col("lang") == x, F.col("dup")))
    return dup.groupBy("source").agg(side("en").alias("head"), F.coalesce(side("de"), F.lit(0)).alias("base")).where("head > base + 0")


@query(
    "q50_base_head_join",
    "select coalesce(b.o_custkey, h.o_custkey) as id, b.n as base_n, h.n as head_n from (select o_custkey, count(*) as n from orders where o_orderstatus = 'F' group by 1) b full join (select o_custkey, count(*) as n from orders where o_orderstatus = 'O' group by 1) h on b.o_custkey = h.o_custkey",
)
def q50(spark: SparkSession, d: str) -> DataFrame:
    side = lambda s: F.nullif(F.count_if(F.col("o_orderstatus") == s), F.lit(0))
    one = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O")).groupBy(F.col("o_custkey").alias("id"))
    return one.agg(side("F").alias("base_n"), side("O").alias("head_n"))


@query("q51_universe_swap", "select doc_id as file, text from documents where doc_id % 10 <> 3 union all select doc_id, upper(lang) from documents where doc_id % 10 = 3")
def q51(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    changed = rows.where("doc_id % 10 = 3")
    return gate.swap_universe(rows.select(F.col("doc_id").alias("file"), "text"), changed.select(F.col("doc_id").alias("file")), changed.select(F.col("doc_id").alias("file"), F.upper("lang").alias("text")))


@query("q52_difference", "select c_custkey as id from customer except select o_custkey from orders")
def q52(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("q53_union_distinct", "select n_nationkey as k from nation union select c_nationkey from customer union select s_nationkey from supplier")
def q53(spark: SparkSession, d: str) -> DataFrame:
    rows = [table(spark, d, t).select(F.col(c).alias("k")) for t, c in (("nation", "n_nationkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return rows[0].union(rows[1]).union(rows[2]).distinct()


@query("q54_option_clamp", "select s_suppkey as id, greatest(least(trunc(s_acctbal), 4294967295), 0)::bigint as option from supplier")
def q54(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.coalesce(clamp_u32(F.col("s_acctbal")), F.lit(40)).alias("option"))


@query(
    "q55_status_parse",
    "with r as (select o_orderkey as id, case o_orderkey % 6 when 0 then 'A' when 1 then 'M' when 2 then 'R087' when 3 then 'D' when 4 then 'C100' else 'X' end as letter from orders) select status, count(*) as n from (select case letter[1] when 'A' then 'added' when 'C' then 'added' when 'M' then 'modified' when 'D' then 'deleted' when 'R' then 'renamed' end as status from r) group by status",
)
def q55(spark: SparkSession, d: str) -> DataFrame:
    letters = F.array(*map(F.lit, ("A", "M", "R087", "D", "C100", "X")))
    rows = table(spark, d, "orders").select(F.get(letters, (F.col("o_orderkey") % 6).cast("int")).alias("letter"))
    return rows.groupBy(git.status_kind(F.col("letter")).alias("status")).agg(F.count("*").alias("n"))


@query("q56_json_report", """select n_regionkey as region, '{"files":' || count(*) || ',"worst":"' || max(n_name) || '"}' as report from nation group by n_regionkey""")
def q56(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.to_json(F.struct(F.count("*").alias("files"), F.max("n_name").alias("worst"))).alias("report"))


@query("q57_gate_summary", f"{RATCHET_SQL} select count(distinct id) as checked, count(*) filter (head_value > allowed) as violations, count(distinct id) filter (base_value = 0) as new_entities from v")
def q57(spark: SparkSession, d: str) -> DataFrame:
    pairs = gate_pairs(spark, d)
    found = gate.ratchet_violations(pairs, gate.ratchets(), ["id"]).agg(F.count("*").alias("violations"))
    return pairs.agg(F.count("*").alias("checked"), F.count_if((F.col("base_cognitive") == 0) | (F.col("base_ncss") == 0) | (F.col("base_nesting") == 0) | (F.col("base_dep_degree") == 0) | (F.col("base_volume") == 0)).alias("new_entities")).crossJoin(found)


@query("q58_locale_order")
def q58(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select("n_name")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.collate("n_name", "UNICODE"))))
