"""Queries over texts as files: a line is a statement, a paragraph a container, a word or sign a token."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeledger.functions import hashing
from treeledger.functions.measures import halstead, ratio, with_percentile
from treeledger.functions.text import SPACE_CLASS, TOKEN, is_blank, is_word, lines_of, split_lines, statements_of, tokens
from treeledger.operators import clones, regions, select, similarity
from treeledger.sources.tables import files_from, table

Q = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def docs(spark: SparkSession, d: str) -> DataFrame:
    return files_from(table(spark, d, "documents"), "doc_id", "text")


LINES = f"""
lines as (
  select doc_id as file, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line
  from (select doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') as l from documents where length(text) > 0)
), marked as (select *, regexp_full_match(line, '[{SPACE_CLASS}]*') as blank from lines)
"""
STATED = f"""{LINES}, contained as (
  select *, sum(blank::int) over (partition by file order by line_no) as container from marked
), stated as (
  select file, container, line_no, line, row_number() over (partition by file, container order by line_no) as pos from contained where not blank
)
"""
TOKENS = f"regexp_extract_all(line, '{TOKEN}')"
WORD = r"regexp_matches(t, '^[\p{L}\p{N}_]')"
SHARED = """shared as (select line from stated where length(line) >= 20 group by line having count(distinct file) > 1),
duplicated as (select distinct file, line_no from stated join shared using (line))"""


def duplicated_lines(stated: DataFrame) -> DataFrame:
    """file, line_no of statements of 20 characters or more that some other file has too."""
    long = stated.where(F.length("line") >= 20)
    shared = long.groupBy("line").agg(F.min("file").alias("a"), F.max("file").alias("b")).where("a < b").select("line")
    return long.join(shared, "line", "left_semi").select("file", "line_no")


@query(
    "q01_rank_documents",
    f"""with {STATED}, {SHARED},
per as (
  select s.file, max(len({TOKENS})) as worst, count(*) as ncss from stated s group by s.file
), dup as (select file, count(*) as dup from duplicated group by file),
every as (select d.doc_id as file, coalesce(worst, 0) as worst, coalesce(ncss, 0) as ncss, coalesce(dup, 0) as dup
  from documents d left join per on per.file = d.doc_id left join dup on dup.file = d.doc_id)
select file, cast(worst as bigint) as worst, ncss, dup,
  round((rank() over (order by worst) - 1) / cast(count(*) over () as double) + (rank() over (order by ncss) - 1) / cast(count(*) over () as double) + (rank() over (order by dup) - 1) / cast(count(*) over () as double), 9) as score
from every""",
)
def rank_documents(spark: SparkSession, d: str) -> DataFrame:
    files = docs(spark, d)
    stated = statements_of(lines_of(files))
    per = stated.groupBy("file").agg(F.max(F.size(tokens(F.col("line")))).alias("worst"), F.count("*").alias("ncss"))
    dup = duplicated_lines(stated).groupBy("file").agg(F.count("*").alias("dup"))
    every = files.select("file").join(per, "file", "left").join(dup, "file", "left").na.fill(0)
    for c in ("worst", "ncss", "dup"):
        every = with_percentile(every, c, f"p_{c}")
    return every.select("file", F.col("worst").cast("bigint").alias("worst"), "ncss", "dup", F.round(F.col("p_worst") + F.col("p_ncss") + F.col("p_dup"), 9).alias("score"))


@query(
    "q02_line_classes",
    f"with {LINES} select d.doc_id as file, count(line) as total, coalesce(sum((not blank)::int), 0)::bigint as code, coalesce(sum(blank::int), 0)::bigint as blank from documents d left join marked on file = d.doc_id group by d.doc_id",
)
def line_classes(spark: SparkSession, d: str) -> DataFrame:
    said = split_lines(F.col("code"))
    blank = F.size(F.filter(said, is_blank)).cast("bigint")
    n = F.size(said).cast("bigint")
    return docs(spark, d).select("file", n.alias("total"), (n - blank).alias("code"), blank.alias("blank"))


@query(
    "q03_summary",
    f"with {LINES}, per as (select file, count(*) as n, max(len({TOKENS})) as worst from marked where not blank group by file) select (select count(*) from documents) as files, sum(n)::bigint as code, coalesce(max(worst), 0)::bigint as worst from per",
)
def summary(spark: SparkSession, d: str) -> DataFrame:
    said = F.filter(split_lines(F.col("code")), lambda x: ~is_blank(x))
    each = docs(spark, d).select(F.size(said).alias("n"), F.array_max(F.transform(said, lambda x: F.size(tokens(x)))).alias("worst"))
    return each.agg(F.count("*").alias("files"), F.sum("n").alias("code"), F.coalesce(F.max("worst"), F.lit(0)).cast("bigint").alias("worst"))


@query(
    "q04_comment_lines_html",
    f"""with l as (select page_id, unnest(regexp_split_to_array(html, '\\r\\n|\\n|\\r')) as line from pages where length(html) > 0)
select page_id, count(*) as total, coalesce(sum((line like '%<!--%' and regexp_full_match(regexp_replace(line, '<!--.*?-->', '', 'g'), '[{SPACE_CLASS}]*'))::int), 0)::bigint as comment_lines,
  coalesce(sum((line like '%<!--%')::int), 0)::bigint as with_comment from l group by page_id""",
)
def comment_lines(spark: SparkSession, d: str) -> DataFrame:
    line = lines_of(files_from(table(spark, d, "pages"), "page_id", "html"))
    has = F.contains(F.col("line"), F.lit("<!--"))
    only = has & is_blank(F.regexp_replace("line", "<!--.*?-->", ""))
    return line.groupBy(F.col("file").alias("page_id")).agg(F.count("*").alias("total"), F.count_if(only).alias("comment_lines"), F.count_if(has).alias("with_comment"))


HALSTEAD_SQL = f"""with t as (select doc_id as file, unnest(regexp_extract_all(text, '{TOKEN}')) as t from documents),
c as (select file, count(distinct t) filter (not {WORD}) as n1, count(distinct t) filter ({WORD}) as n2, count(*) filter (not {WORD}) as total1, count(*) filter ({WORD}) as total2 from t group by file)"""


def halstead_counts(spark: SparkSession, d: str) -> DataFrame:
    each = docs(spark, d).select("file", F.explode(tokens(F.col("code"))).alias("t")).groupBy("file", "t").agg(F.count("*").alias("n"))
    word = is_word(F.col("t"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy("file").agg(F.count_if(~word).alias("n1"), F.count_if(word).alias("n2"), total(~word).alias("total1"), total(word).alias("total2"))


@query("q05_halstead_counts", f"{HALSTEAD_SQL} select * from c")
def q05(spark: SparkSession, d: str) -> DataFrame:
    return halstead_counts(spark, d)


@query(
    "q06_halstead_derived",
    f"""{HALSTEAD_SQL} select file, n1 + n2 as vocabulary, total1 + total2 as length,
round(case when n1 + n2 > 0 then (total1 + total2) * log2(n1 + n2) else 0 end, 4) as volume,
round(case when n2 > 0 then (n1 / 2.0::double) * (total2 / n2::double) * ((total1 + total2) * log2(n1 + n2)) else 0 end, 1) as effort from c""",
)
def q06(spark: SparkSession, d: str) -> DataFrame:
    h = halstead(F.col("n1"), F.col("n2"), F.col("total1"), F.col("total2"))
    return halstead_counts(spark, d).select("file", h["vocabulary"].alias("vocabulary"), h["length"].alias("length"), F.round(h["volume"], 4).alias("volume"), F.round(h["effort"], 1).alias("effort"))


@query("q07_percentile_rank", "select doc_id, round((rank() over (order by n_chars) - 1) / cast(count(*) over () as double), 9) as percentile from documents")
def q07(spark: SparkSession, d: str) -> DataFrame:
    return with_percentile(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "p").select("doc_id", F.round("p", 9).alias("percentile"))


@query(
    "q08_worst_line",
    f"with {STATED}, r as (select *, len({TOKENS}) as n, row_number() over (partition by file order by len({TOKENS}) desc, length(line) desc, line_no) as k from stated) select file, line_no, n::int as n_tokens, length(line)::int as n_chars from r where k = 1",
)
def q08(spark: SparkSession, d: str) -> DataFrame:
    line = lines_of(docs(spark, d)).where(~F.col("blank")).select("file", "line_no", F.size(tokens(F.col("line"))).alias("n"), F.length("line").alias("c"))
    best = line.groupBy("file").agg(F.max_by(F.struct("line_no", "n", "c"), F.struct("n", "c", -F.col("line_no"))).alias("w"))
    return best.select("file", F.col("w.line_no").cast("bigint").alias("line_no"), F.col("w.n").alias("n_tokens"), F.col("w.c").alias("n_chars"))


@query(
    "q14_literal_dense",
    f"with t as (select doc_id as file, unnest(regexp_extract_all(text, '{TOKEN}')) as t from documents) select file, count(*) as n_tokens, count(*) filter (regexp_matches(t, '^[0-9]')) as literals, 5 * count(*) filter (regexp_matches(t, '^[0-9]')) >= count(*) as dense from t group by file",
)
def q14(spark: SparkSession, d: str) -> DataFrame:
    said = tokens(F.col("code"))
    n, lit = F.size(said).cast("bigint"), F.size(F.filter(said, lambda t: t.rlike("^[0-9]"))).cast("bigint")
    return docs(spark, d).select("file", n.alias("n_tokens"), lit.alias("literals"), (lit * 5 >= n).alias("dense")).where("n_tokens > 0")


@query(
    "q15_literal_prefix",
    f"with {LINES} select file, line_no, sum(len(list_filter({TOKENS}, lambda t: regexp_matches(t, '^[0-9]')))) over (partition by file order by line_no)::bigint as upto from marked",
)
def q15(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter(tokens(F.col("line")), lambda t: t.rlike("^[0-9]")))
    return lines_of(docs(spark, d)).select("file", F.col("line_no").cast("bigint").alias("line_no"), F.sum(n).over(Window.partitionBy("file").orderBy("line_no")).alias("upto"))


NAMES = "names as (select n_name as name from nation union select r_name from region)"


def names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "region").select("r_name")).distinct()


@query("q16_xor_hash", f"with {NAMES} select name, list_reduce(list_prepend(5381::bigint, list_transform(string_split(name, ''), lambda c: ord(c)::bigint)), lambda h, u: xor((h * 33) & 4294967295, u)) as hash from names")
def q16(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("name", hashing.xor_hash(F.col("name")).alias("hash"))


@query("q17_fnv_hash", f"with {NAMES} select name, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(name, ''), lambda c: ord(c)::bigint)), lambda h, u: (xor(h, u) * 16777619) & 4294967295) as hash from names")
def q17(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("name", hashing.fnv_hash(F.col("name")).alias("hash"))


FINGERPRINT = r"md5(array_to_string(list_transform(said, lambda t: case when regexp_matches(t, '^[\p{L}_]') then '$' || list_position(said, t)::varchar else t end), ' ')) || ':' || len(said)::varchar"


@query(
    "q18_fingerprints",
    f"with {STATED}, k as (select file, {FINGERPRINT} as key from (select file, {TOKENS} as said from stated) where len(said) > 0) select key, count(*) as n, count(distinct file) as files from k group by key",
)
def q18(spark: SparkSession, d: str) -> DataFrame:
    each = regions.each_file(docs(spark, d), regions.line_rows, "key string, n bigint", whole=False)
    return each.groupBy("key").agg(F.sum("n").alias("n"), F.count_distinct("file").alias("files"))


WINDOWS = f"""{STATED}, w as (
  select a.file, a.container, a.pos, b.pos - a.pos + 1 as len, a.line_no as first_line, b.line_no as last_line,
    (select md5(string_agg(c.line, chr(10) order by c.pos)) from stated c where c.file = a.file and c.container = a.container and c.pos between a.pos and b.pos) as key,
    (select count(distinct c.line) from stated c where c.file = a.file and c.container = a.container and c.pos between a.pos and b.pos) as distinct_lines
  from stated a join stated b on a.file = b.file and a.container = b.container and b.pos between a.pos + 1 and a.pos + 4
), rep as (
  select key, count(*) as occurrences, count(distinct file) as files from w where distinct_lines > 1 group by key
  having count(*) > 1 and (max(pos) - min(pos) >= max(len) or count(distinct (file, container)) > 1)
)"""


def five_windows(spark: SparkSession, d: str) -> DataFrame:
    return clones.windows(docs(spark, d), 5)


def five_repeating(spark: SparkSession, d: str) -> DataFrame:
    return clones.repeating(docs(spark, d), 5)


def hexed():
    return F.lower(F.hex("key")).alias("key")


@query("q19_statement_windows", f"with {WINDOWS} select len::int as len, count(*) as windows, count(distinct key) as keys from w group by len")
def q19(spark: SparkSession, d: str) -> DataFrame:
    return five_windows(spark, d).groupBy("len").agg(F.count("*").alias("windows"), F.count_distinct("key").alias("keys"))


@query("q20_repeated_windows", f"with {WINDOWS} select * from rep")
def q20(spark: SparkSession, d: str) -> DataFrame:
    return five_repeating(spark, d).select(hexed(), "occurrences", "files")


@query(
    "q21_maximal_windows",
    f"""with {WINDOWS}, hot as (select w.* from w join rep using (key))
select file, first_line, last_line, len::int as len, key from hot w
where not exists (select 1 from hot l where l.file = w.file and l.container = w.container and l.len = w.len + 1 and l.pos in (w.pos, w.pos - 1))""",
)
def q21(spark: SparkSession, d: str) -> DataFrame:
    return clones.maximal(five_windows(spark, d), five_repeating(spark, d)).select("file", F.col("first_line").cast("bigint").alias("first_line"), F.col("last_line").cast("bigint").alias("last_line"), "len", hexed())


BLOCKS = f"""{STATED}, b as (
  select file, container, flatten(list({TOKENS} order by line_no)) as said, min(line_no) as first_line, max(line_no) as last_line from stated group by file, container
), blocks as (select file, container, len(said) as n_tokens, 'b:' || {FINGERPRINT} as key, first_line, last_line from b where len(said) >= 40),
crossing as (select * from blocks where key in (select key from blocks group by key having count(distinct file) > 1))"""


def doc_blocks(spark: SparkSession, d: str) -> DataFrame:
    return clones.blocks(docs(spark, d))


def long(*cols: str):
    return [F.col(c).cast("bigint").alias(c) for c in cols]


@query("q22_block_candidates", f"with {BLOCKS} select file, n_tokens::bigint as n_tokens, key, first_line, last_line from blocks")
def q22(spark: SparkSession, d: str) -> DataFrame:
    return doc_blocks(spark, d).select("file", "key", *long("n_tokens", "first_line", "last_line"))


@query(
    "q23_region_dedupe",
    f"with {BLOCKS}, r as (select *, row_number() over (partition by key order by n_tokens desc, file, container) as k from blocks) select key, file, first_line, last_line from r where k = 1",
)
def q23(spark: SparkSession, d: str) -> DataFrame:
    best = doc_blocks(spark, d).groupBy("key").agg(F.max_by(F.struct("file", "first_line", "last_line"), F.struct("n_tokens", -F.col("file"), -F.col("container"))).alias("b"))
    return best.select("key", "b.file", F.col("b.first_line").cast("bigint").alias("first_line"), F.col("b.last_line").cast("bigint").alias("last_line"))


@query("q24_cross_file_groups", f"with {BLOCKS} select key, count(*) as occurrences, count(distinct file) as files, max(n_tokens)::bigint as n_tokens from crossing group by key")
def q24(spark: SparkSession, d: str) -> DataFrame:
    each = doc_blocks(spark, d).groupBy("key").agg(F.count("*").alias("occurrences"), F.count_distinct("file").alias("files"), F.max("n_tokens").cast("bigint").alias("n_tokens"))
    return each.where("files > 1")


@query("q25_greedy_selection")
def q25(spark: SparkSession, d: str) -> DataFrame:
    hot = five_windows(spark, d).join(five_repeating(spark, d), "key", "left_semi").select("file", hexed(), "first_line", "last_line", F.col("len").alias("n_tokens"))
    return select.select_regions(hot)


@query(
    "q27_clone_lines",
    f"with {BLOCKS}, c as (select distinct file, unnest(range(first_line, last_line + 1)) as line_no from crossing) select file, count(*) as clone_lines from c group by file",
)
def q27(spark: SparkSession, d: str) -> DataFrame:
    return clones.covered_lines(clones.cross_file(doc_blocks(spark, d))).groupBy("file").agg(F.count("*").alias("clone_lines"))


@query(
    "q28_partners",
    f"with {BLOCKS}, p as (select distinct a.file, b.file as other from crossing a join crossing b on a.key = b.key and a.file <> b.file) select file, string_agg(other::varchar, ',' order by other) as partners from p group by file",
)
def q28(spark: SparkSession, d: str) -> DataFrame:
    return clones.partners(clones.cross_file(doc_blocks(spark, d))).select("file", F.concat_ws(",", F.transform("partners", lambda x: x.cast("string"))).alias("partners"))


@query(
    "q29_duplication_ratio",
    f"with {STATED}, {SHARED}, n as (select file, count(*) as code from stated group by file), k as (select file, count(*) as dup from duplicated group by file) select file, code, coalesce(dup, 0) as dup, round(coalesce(dup, 0) / code::double, 9) as ratio from n left join k using (file)",
)
def q29(spark: SparkSession, d: str) -> DataFrame:
    stated = lines_of(docs(spark, d)).where(~F.col("blank"))
    n = stated.groupBy("file").agg(F.count("*").alias("code"))
    k = duplicated_lines(stated).groupBy("file").agg(F.count("*").alias("dup"))
    return n.join(k, "file", "left").na.fill(0).select("file", "code", "dup", F.round(ratio(F.col("dup"), F.col("code")), 9).alias("ratio"))


GRAMS = """
wb as (select item_id as id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as w from benchmark),
wd as (select doc_id as id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as w from documents),
gb as (select distinct id, array_to_string(w[i:i+4], ' ') as gram from (select id, w, unnest(range(1, len(w) - 3)) as i from wb where len(w) >= 5)),
gd as (select distinct id, array_to_string(w[i:i+4], ' ') as gram from (select id, w, unnest(range(1, len(w) - 3)) as i from wd where len(w) >= 5)),
shared as (select a.id as a, b.id as b, count(*) as shared from gb a join gd b using (gram) group by 1, 2)"""


def word_list(text):
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def gram_pairs(spark: SparkSession, d: str) -> DataFrame:
    texts = lambda t, i: table(spark, d, t).select(F.col(i).alias("id"), "text")
    return similarity.shared_ngrams(texts("benchmark", "item_id"), texts("documents", "doc_id"))


@query("q30_shared_ngrams", f"with {GRAMS} select * from shared")
def q30(spark: SparkSession, d: str) -> DataFrame:
    return gram_pairs(spark, d)


@query(
    "q31_content_overlap",
    f"""with {GRAMS}, cb as (select id, t, count(*) as n from (select id, unnest(w) as t from wb) group by 1, 2), cd as (select id, t, count(*) as n from (select id, unnest(w) as t from wd) group by 1, 2)
select a, b, sum(least(cb.n, cd.n))::bigint as overlap from shared join cb on cb.id = a join cd on cd.id = b and cd.t = cb.t group by a, b""",
)
def q31(spark: SparkSession, d: str) -> DataFrame:
    rows = lambda t, i: table(spark, d, t).select(F.col(i).alias("id"), word_list(F.col("text")).alias("said"))
    return similarity.overlap(rows("benchmark", "item_id"), rows("documents", "doc_id"), gram_pairs(spark, d).select("a", "b"))


@query("q32_near_miss")
def q32(spark: SparkSession, d: str) -> DataFrame:
    pairs = gram_pairs(spark, d).where("shared >= 10").select("a", "b")
    said = lambda t, i, name: table(spark, d, t).select(F.col(i).alias(name), word_list(F.col("text")).alias(f"s{name}"))
    both = pairs.join(said("benchmark", "item_id", "a"), "a").join(said("documents", "doc_id", "b"), "b")
    return both.select("a", "b", similarity.lcs_percent("sa", "sb").alias("percent"))


@query(
    "q33_components",
    f"""with recursive {GRAMS}, e as (select a as x, 1000000000 + b as y from shared union all select 1000000000 + b, a from shared),
reach as (select distinct x, x as root from e union select e.y, reach.root from reach join e on e.x = reach.x)
select x as id, min(root) as root from reach group by x""",
)
def q33(spark: SparkSession, d: str) -> DataFrame:
    return similarity.components(gram_pairs(spark, d).select("a", (F.col("b") + 1_000_000_000).alias("b")))


@query(
    "q36_tag_containment",
    """with t as (select page_id, unnest(range(1, len(m) + 1)) as i, unnest(m) as tag from (select page_id, regexp_extract_all(html, '</?(?:div|article|nav|ul|li|footer)\\b') as m from pages)),
dd as (select page_id, i, tag, sum(case when tag like '</%' then -1 else 1 end) over (partition by page_id order by i) as depth from t)
select page_id, count(*) filter (tag not like '</%') as opened, coalesce(max(depth), 0)::bigint as deepest, sum(case when tag not like '</%' then depth else 0 end)::bigint as weighted from dd group by page_id""",
)
def q36(spark: SparkSession, d: str) -> DataFrame:
    tags = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"</?(?:div|article|nav|ul|li|footer)\b"), F.lit(0))).alias("i", "tag"))
    step = F.when(F.startswith("tag", F.lit("</")), -1).otherwise(1)
    deep = tags.withColumn("opens", step == 1).withColumn("depth", F.sum(step).over(Window.partitionBy("page_id").orderBy("i")))
    return deep.groupBy("page_id").agg(F.count_if("opens").alias("opened"), F.coalesce(F.max("depth"), F.lit(0)).alias("deepest"), F.sum(F.when(F.col("opens"), F.col("depth")).otherwise(0)).alias("weighted"))


@query(
    "q40_def_use",
    """with w as (select conv_id, turn, i, t from (select conv_id, turn, unnest(range(1, len(m) + 1)) as i, unnest(m) as t from (select conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as m from conversations)))
select conv_id, count(*) as n_words, count(*) - count(distinct t) as reads from w group by conv_id""",
)
def q40(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "conversations").select("conv_id", F.explode(word_list(F.col("text"))).alias("t"))
    per = said.groupBy("conv_id", "t").agg(F.count("*").alias("n"))
    return per.groupBy("conv_id").agg(F.sum("n").alias("n_words"), (F.sum("n") - F.count("*")).alias("reads"))


@query("q60_sequences", "select conv_id, string_agg(role, '>' order by turn) as roles, count(*) as n from conversations group by conv_id")
def q60(spark: SparkSession, d: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["role"]), ">").alias("roles"), F.count("*").alias("n"))


@query("q59_file_offsets", "select doc_id as file, (sum(n_chars + 1) over (order by doc_id) - n_chars - 1)::bigint as start_at from documents")
def q59(spark: SparkSession, d: str) -> DataFrame:
    """Running offsets in two steps, so that no one task orders all files."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("file"), (F.col("n_chars") + 1).alias("n"), F.floor(F.col("doc_id") / 1000).alias("part"))
    sums = rows.groupBy("part").agg(F.sum("n").alias("own"))
    before = sums.select("part", (F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("file"))
    return rows.withColumn("upto", upto).join(before, "part").select("file", (F.col("before") + F.col("upto") - F.col("n")).alias("start_at"))
