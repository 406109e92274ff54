"""Queries of the code-search operators over the driver's tables, each with its DuckDB SQL where SQL can express it.

fifth, a class definition. All queries run over their whole tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .functions.wordpiece import WordPiece, token_ids
from .operators import bm25, chunking, fusion
from .plans import index as plans
from .sources import store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- documents as chunks ------------------------------------------------------------------------------------------------

FOLDERS = ["src/", "tests/", "examples/", "lib/compat/", "src/core/", "a/b/c/"]
SUFFIXES = [".py", ".d.ts", "_test.go", ".rs", ".java"]


def _pick(options: list[str], by: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in options)), (by % len(options) + 1).cast("int"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    content = F.when(i % 5 == 0, F.concat(F.lit("class Doc"), i % 50, F.lit("Parser:\n"), F.col("text"))).otherwise(F.col("text"))
    path = F.concat(_pick(FOLDERS, i), F.col("source"), F.lit("/doc_"), i % 50, F.lit("_parser"), _pick(SUFFIXES, i))
    return d.select(i.alias("chunk_idx"), path.alias("file_path"), F.col("lang").alias("language"), i.cast("int").alias("start_line"), (i + T.newlines(F.col("text"))).cast("int").alias("end_line"), content.alias("content"))


def _sql_pick(options: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in options) + f"][CAST(doc_id % {len(options)} AS INTEGER) + 1]"


CORPUS = f"""corpus AS (
  SELECT doc_id AS chunk_idx, {_sql_pick(FOLDERS)} || source || '/doc_' || (doc_id % 50) || '_parser' || {_sql_pick(SUFFIXES)} AS file_path,
         lang AS language, CAST(doc_id AS INTEGER) AS start_line, CAST(doc_id + length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS end_line,
         CASE WHEN doc_id % 5 = 0 THEN 'class Doc' || (doc_id % 50) || 'Parser:' || chr(10) || text ELSE text END AS content
  FROM documents)"""


def s_base(p: str) -> str:
    return f"string_split(replace({p}, chr(92), '/'), '/')[-1]"


def s_stem(p: str) -> str:
    return rf"regexp_extract({s_base(p)}, '(?s)^(.+?)(?:\.[^.]*)?\z', 1)"


def s_parent(p: str) -> str:
    return f"CASE WHEN len(string_split(replace({p}, chr(92), '/'), '/')) < 2 THEN '' ELSE string_split(replace({p}, chr(92), '/'), '/')[-2] END"


def s_stems(c: str) -> str:
    x = f"regexp_replace({c}, '[^A-Za-z0-9]+', ' ', 'g')"
    for a, b in (("[a-z0-9]", "[A-Z]"), ("[A-Z]", "[A-Z][a-z]"), ("[A-Za-z]", "[0-9]"), ("[0-9]", "[A-Za-z]")):
        x = rf"regexp_replace({x}, '({a})({b})', '\1 \2', 'g')"
    return f"list_filter(string_split(lower({x}), ' '), lambda x: x <> '')"


def s_split(w: str) -> str:
    """T3 of an identifier."""
    camel = rf"regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace({w}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([0-9])([a-z])', '\1 \2', 'g')), '[a-z]+|[0-9]+')"
    parts = f"CASE WHEN contains({w}, '_') THEN list_filter(string_split(lower({w}), '_'), lambda p: p <> '') ELSE {camel} END"
    return f"CASE WHEN len({parts}) >= 2 THEN list_concat([lower({w})], {parts}) ELSE [lower({w})] END"


def s_tokens(c: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({c}, '[A-Z_a-z][0-9A-Z_a-z]*'), lambda w: {s_split('w')}))"


def s_folders(p: str) -> str:
    parts = f"list_filter(string_split(replace({p}, chr(92), '/'), '/'), lambda x: x <> '')"
    return f"array_to_string(list_reverse(list_reverse({parts}[:-2])[1:3]), ' ')"


def s_enrich(c: str, p: str) -> str:
    return f"CASE WHEN {p} = '' THEN {c} ELSE {c} || ' ' || {s_stem(p)} || ' ' || {s_stem(p)} || ' ' || {s_folders(p)} END"


BM25_TABLES = f"""{CORPUS},
tokens AS (SELECT chunk_idx, {s_tokens(s_enrich("content", "file_path"))} AS tokens FROM corpus),
sized AS (SELECT chunk_idx, len(tokens) AS doc_len FROM tokens),
postings AS (SELECT chunk_idx, term, count(*) AS tf FROM (SELECT chunk_idx, unnest(tokens) AS term FROM tokens) GROUP BY 1, 2),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
stats AS (SELECT count(*) AS n_docs, coalesce(avg(doc_len), 0) AS avg_len FROM sized)"""


def s_score(terms: str, k1: float = 1.5, b: float = 0.75, where: str = "true") -> str:
    """(query_id, chunk_idx, score) for a relation of (query_id, term)."""
    return f"""SELECT query_id, chunk_idx, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * ({k1} + 1)) / (tf + {k1} * (1 - {b} + {b} * doc_len / avg_len))), 9) AS score
  FROM (SELECT DISTINCT query_id, term FROM {terms}) q JOIN postings USING (term) JOIN terms USING (term) JOIN sized USING (chunk_idx), stats WHERE {where} GROUP BY 1, 2"""


def s_ranked(scores: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_idx) AS rank FROM {scores}) WHERE rank <= {k}"


def _terms(spark: SparkSession, text: str) -> DataFrame:
    return bm25.query_terms(spark.range(0, 1, 1, 1).select(F.lit(0).alias("query_id"), F.lit(text).alias("query")))


def s_terms(text: str) -> str:
    return f"(SELECT 0 AS query_id, unnest(list_distinct({s_tokens(repr(text))})) AS term)"


def _lexical(spark: SparkSession, sf_dir: str, **how) -> tuple[DataFrame, bm25.Bm25]:
    """Chunks and their statistics; ids that repeat are put together."""
    chunks = corpus(spark, sf_dir)
    repeated = not chunks.groupBy("chunk_idx").count().where("count > 1").isEmpty()
    return chunks, bm25.build(bm25.token_table(chunks), **how) if repeated else bm25.of_chunks(chunks, **how)


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, k1: float = 1.5, b: float = 0.75) -> plans.CodeIndex:
    """The index of the corpus, built and saved once in a session and read from its files by every query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        chunks, lexical = _lexical(spark, sf_dir)
        vectors = _vectors(spark, sf_dir).join(chunks.select("chunk_idx"), "chunk_idx", "left_semi")
        path = f"{store.shared_folder(spark)}/index-{uuid.uuid4().hex}"
        plans.CodeIndex(spark, chunks, lexical, vectors).save(path)
        _STORED[key] = path
    return plans.CodeIndex.load(spark, _STORED[key], vectors=True, k1=k1, b=b)


# --- text functions -----------------------------------------------------------------------------------------------------


@query("t1_identifier_stems", f"SELECT page_id, array_to_string({s_stems('url')}, ' ') AS stems FROM pages")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(T.stems(F.col("url")), " ").alias("stems"))


@query("t2_tokenize_text", f"SELECT page_id, array_to_string({s_tokens('html')}, ' ') AS tokens FROM pages")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(T.tokenize(F.col("html")), " ").alias("tokens"))


_NAMES = """names AS (SELECT p_partkey, p_partkey % 4 AS k, string_split(p_name, ' ') AS w, p_type, p_size FROM part),
idents AS (SELECT p_partkey, CASE k WHEN 0 THEN lower(w[1]) || '_' || upper(w[2]) || '_' || p_size
  WHEN 1 THEN lower(w[1]) || upper(w[2][1]) || lower(w[2][2:]) || p_size
  WHEN 2 THEN p_type || upper(w[1][1]) || lower(w[1][2:]) ELSE lower(w[2]) END AS ident FROM names)"""


def _idents(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("p_name", " ")
    a, b, k = F.element_at(w, 1), F.element_at(w, 2), F.col("p_partkey") % 4
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))
    ident = F.when(k == 0, F.concat(F.lower(a), F.lit("_"), F.upper(b), F.lit("_"), "p_size")).when(k == 1, F.concat(F.lower(a), cap(b), "p_size")).when(k == 2, F.concat("p_type", cap(a))).otherwise(F.lower(b))
    return read(spark, sf_dir, "part").select("p_partkey", ident.alias("ident"))


@query("t3_split_identifier", f"WITH {_NAMES} SELECT p_partkey, ident, array_to_string({s_split('ident')}, ' ') AS parts, array_to_string({s_stems('ident')}, ' ') AS stems FROM idents")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _idents(spark, sf_dir).select("p_partkey", "ident", F.array_join(T.split_identifier(F.col("ident")), " ").alias("parts"), F.array_join(T.stems(F.col("ident")), " ").alias("stems"))


@query("t4_enrich_path", f"WITH {CORPUS} SELECT chunk_idx, {s_enrich('content', 'file_path')} AS enriched FROM corpus")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("chunk_idx", T.enrich(F.col("content"), F.col("file_path")).alias("enriched"))


_BENCH_WORDS = "words AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Z_a-z][0-9A-Z_a-z]*')) AS w FROM benchmark)), forms AS (SELECT item_id, f, CASE f WHEN 0 THEN w WHEN 1 THEN 'ns::' || w WHEN 2 THEN w || '->' || upper(w) WHEN 3 THEN '_' || w WHEN 4 THEN ' App.' || w || '.Run ' ELSE w || ' ' || w END AS q FROM words, (SELECT unnest(range(0, 6)) AS f))"


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit(T.IDENTIFIER), F.lit(0))).alias("w")).distinct()
    f, w = F.col("f"), F.col("w")
    q = F.when(f == 0, w).when(f == 1, F.concat(F.lit("ns::"), w)).when(f == 2, F.concat(w, F.lit("->"), F.upper(w))).when(f == 3, F.concat(F.lit("_"), w)).when(f == 4, F.concat(F.lit(" App."), w, F.lit(".Run "))).otherwise(F.concat(w, F.lit(" "), w))
    return words.select("item_id", "w", F.explode(F.array(*(F.lit(i) for i in range(6)))).alias("f")).select("item_id", "f", q.alias("q"))


_S_SYMBOL = rf"regexp_full_match(trim(q), '{T.SYMBOL}')"


@query(
    "t8_t10_symbol_query",
    rf"""WITH {_BENCH_WORDS} SELECT item_id, CAST(f AS INTEGER) AS f, q, {_S_SYMBOL} AS is_symbol, CASE WHEN {_S_SYMBOL} THEN 0.3 ELSE 0.5 END::DOUBLE AS alpha,
 CASE WHEN contains(q, '::') THEN string_split(trim(q), '::')[-1] WHEN contains(q, '->') THEN string_split(trim(q), '->')[-1] WHEN contains(q, '.') THEN string_split(trim(q), '.')[-1] ELSE trim(q) END AS name FROM forms""",
)
def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    return _forms(spark, sf_dir).select("item_id", "f", "q", T.is_symbol(q).alias("is_symbol"), T.alpha(q).cast("double").alias("alpha"), T.symbol_name(q).alias("name"))


@query(
    "t11_embedded_symbols",
    f"WITH {_NAMES} SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all('find ' || ident || ' near ' || ident || ' XMLThing fooBar fooB', '[A-Za-z0-9_]+'), lambda w: regexp_full_match(w, '{T.CAMEL_WORD}')))), ' ') AS symbols FROM idents",
)
def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat(F.lit("find "), "ident", F.lit(" near "), "ident", F.lit(" XMLThing fooBar fooB"))
    return _idents(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort(T.embedded_symbols(q)), " ").alias("symbols"))


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(T.STOPWORDS)) + "]"
_S_KEYWORDS = f"list_filter(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Z_a-z][0-9A-Z_a-z]*'), lambda w: lower(w)), lambda w: length(w) > 2)), lambda w: NOT list_contains({_STOP}, w))"
_S_PARTS = f"list_distinct(list_concat({s_stems(s_stem('file_path'))}, CASE WHEN {s_parent('file_path')} IN ('', '.', '..') THEN [] ELSE {s_stems(s_parent('file_path'))} END))"


@query("t16_keywords", f"SELECT item_id, array_to_string(list_sort({_S_KEYWORDS}), ' ') AS keywords FROM benchmark")
def t16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(T.keywords(F.col("text"))), " ").alias("keywords"))


_URL_PATH = r"regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g')"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://|[?#].*$", "").alias("url"))
    return p.select("page_id", F.concat("url", F.lit("/"), _pick(FOLDERS, F.col("page_id")), F.lit("theThing_"), F.col("page_id") % 7, F.lit("Of"), _pick(SUFFIXES, F.col("page_id"))).alias("file_path"))


_PATHS = f"paths AS (SELECT page_id, {_URL_PATH} || '/' || {_sql_pick(FOLDERS).replace('doc_id', 'page_id')} || 'theThing_' || (page_id % 7) || 'Of' || {_sql_pick(SUFFIXES).replace('doc_id', 'page_id')} AS file_path FROM pages)"


@query("t17_path_parts", f"WITH {_PATHS} SELECT page_id, {s_base('file_path')} AS base, {s_stem('file_path')} AS stem, {s_parent('file_path')} AS parent, array_to_string(list_sort({_S_PARTS}), ' ') AS parts FROM paths")
def t17(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("file_path")
    return _paths(spark, sf_dir).select("page_id", T.base_name(p).alias("base"), T.path_stem(p).alias("stem"), T.parent_name(p).alias("parent"), F.array_join(F.array_sort(T.path_parts(p)), " ").alias("parts"))


@query(
    "t18_keyword_overlap",
    f"""WITH {_PATHS}, n AS (SELECT max(item_id) + 1 AS n FROM benchmark), p AS (SELECT page_id, page_id % n AS item_id, {_S_PARTS} AS parts, {s_stem('file_path')} || '@' || {s_parent('file_path')} AS place FROM paths, n),
 q AS (SELECT item_id, list_concat({_S_KEYWORDS}, ['thing', 'core', 'par']) AS ks FROM benchmark)
 SELECT page_id, item_id, place, len(list_filter(ks, lambda k: list_contains(parts, k))) + len(list_filter(ks, lambda k: NOT list_contains(parts, k) AND len(list_filter(parts, lambda p: least(length(p), length(k)) >= 3 AND (starts_with(p, k) OR starts_with(k, p)))) > 0)) AS matches FROM q JOIN p USING (item_id)""",
)
def t18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path with one test item, in turn."""
    p, items = F.col("file_path"), read(spark, sf_dir, "benchmark")
    n = F.broadcast(items.agg((F.max("item_id") + 1).alias("n")))  # one row
    places = _paths(spark, sf_dir).crossJoin(n).select("page_id", (F.col("page_id") % F.col("n")).alias("item_id"), T.path_parts(p).alias("parts"), F.concat(T.path_stem(p), F.lit("@"), T.parent_name(p)).alias("place"))
    q = items.select("item_id", F.concat(F.coalesce(T.keywords(F.col("text")), F.array().cast("array<string>")), F.array(F.lit("thing"), F.lit("core"), F.lit("par"))).alias("ks"))
    return q.join(places, "item_id").select("page_id", "item_id", "place", T.keyword_matches(F.col("ks"), F.col("parts")).cast("long").alias("matches"))


_RE2_TEST = T.TEST_FILE
_IN = {k: f"regexp_matches(file_path, '(?:^|/)(?:{v})(?:/|$)')" for k, v in T.FOLDERS.items()}


def s_penalty(p: str) -> str:
    x = f"""((CASE WHEN regexp_matches(file_path, '{_RE2_TEST}') OR {_IN['test']} THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END)
 * (CASE WHEN {s_base('file_path')} IN ('__init__.py', 'package-info.java') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)
 * (CASE WHEN {_IN['compat']} THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN {_IN['examples']} THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END)
 * (CASE WHEN file_path LIKE '%.d.ts' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END))"""
    return x.replace("file_path", p)


@query("t19_path_penalty", f"WITH {_PATHS} SELECT page_id, round({s_penalty('file_path')}, 9) AS penalty FROM paths")
def t19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", F.round(T.path_penalty(F.col("file_path")), 9).alias("penalty"))


@query("s6_language_of_path", f"WITH {_PATHS} SELECT page_id, CASE regexp_extract(lower(file_path), '(\\.[^.]*)\\z', 1) " + " ".join(f"WHEN '.{k}' THEN '{v}'" for k, v in T.EXTENSIONS.items()) + " END AS language FROM paths")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", T.language(F.col("file_path")).alias("language"))


@query("s6b_supported_grammars", "SELECT * FROM (VALUES " + ", ".join(f"('.{k}', '{v}')" for k, v in T.EXTENSIONS.items()) + ") t(extension, grammar)")
def s6b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(f".{k}", v) for k, v in T.EXTENSIONS.items()], "extension string, grammar string")


RULES = ["*.d.ts", "compat/", "/www.*", "core/theThing_?Of.java", "a/b/c/"]


@query(
    "s4_ignore_filter",
    rf"""WITH {_PATHS} SELECT page_id, file_path FROM paths WHERE NOT (
 len(list_filter(string_split(file_path, '/'), lambda s: list_contains([{", ".join(f"'{d}'" for d in T.IGNORED_FOLDERS)}], s) OR regexp_full_match(s, '[^/]*\.d\.ts') OR s = 'compat')) > 0
 OR regexp_full_match(file_path, 'www\.[^/]*') OR regexp_full_match(file_path, 'core/theThing_[^/]Of\.java') OR ends_with(file_path, '/core/theThing_?Of.java') OR file_path = 'a/b/c' OR starts_with(file_path, 'a/b/c/'))""",
)
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(~T.ignored(F.col("file_path"), RULES))


_S_DEFINES = "regexp_matches(content, '(?m)(?:^|\\s)(?:{d})\\s+(?:[A-Z_a-z][0-9A-Z_a-z]*(?:\\.|::))*(?:{n})(?:\\s|[;:\\[\\{{(<]|$)')"


def s_tier(names: list[str], content: str = "content", path: str = "file_path") -> str:
    define = _S_DEFINES.format(d=T.DEFINERS, n="|".join(names)).replace("content", content)
    stem = f"lower({s_stem(path)})"
    bare = f"replace({stem}, '_', '')"
    match = " OR ".join(f"{x} = '{n.lower()}'" for n in names for x in (stem, bare, f"rtrim({stem}, 's')", f"rtrim({bare}, 's')"))
    return f"CASE WHEN {define} THEN CASE WHEN {match} THEN 1.5 ELSE 1.0 END ELSE 0.0 END"


@query("t12_t14_defines_symbol", f"WITH {CORPUS} SELECT chunk_idx, CAST({s_tier(['Doc15Parser', 'Doc20Parser'])} AS DOUBLE) AS tier FROM corpus")
def t12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("chunk_idx", fusion.tier(F.col("content"), F.col("file_path"), ["Doc15Parser", "Doc20Parser"]).alias("tier"))


@query(
    "t15_embedded_stem_match",
    f"""WITH {CORPUS}, s AS (SELECT DISTINCT lower({s_stem('file_path')}) AS stem FROM corpus)
 SELECT stem, len(list_filter(['doc15parserfactory', 'doc_7_parser'], lambda s: s = stem OR s = replace(stem, '_', '') OR (length(stem) >= 4 AND starts_with(s, stem)) OR (length(replace(stem, '_', '')) >= 4 AND starts_with(s, replace(stem, '_', ''))))) > 0 AS matches FROM s""",
)
def t15(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpus(spark, sf_dir).select(F.lower(T.path_stem(F.col("file_path"))).alias("stem")).distinct()
    return s.select("stem", T.embedded_stem_matches(F.col("stem"), F.array(F.lit("doc15parserfactory"), F.lit("doc_7_parser"))).alias("matches"))


# --- lines and spans ----------------------------------------------------------------------------------------------------

_LINES = """lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
ends AS (SELECT doc_id, text, list_transform(range(1, len(l) + 1), lambda i: CAST(least(list_sum(list_transform(l[1:i], lambda x: strlen(x) + 1)), strlen(text)) AS INTEGER)) AS e FROM lines)"""


@query(
    "p8_line_numbers",
    "SELECT doc_id, CAST(n AS INTEGER) AS line, CAST(b AS INTEGER) AS start_byte, CAST(b + strlen(s) AS INTEGER) AS end_byte, s AS content FROM (SELECT doc_id, n, s, coalesce(sum(strlen(s) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)) WHERE s <> ''",
)
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chunking.lines(read(spark, sf_dir, "documents"), "doc_id", "text")
    return lines.where("content <> ''").select("doc_id", "line", "start_byte", "end_byte", "content")


@query("p7_byte_slice", "SELECT doc_id, length(regexp_extract(text, '^[^\\n]*', 0)) AS head, substr(text, length(regexp_extract(text, '^[^\\n]*', 0)) + 2) AS rest, CAST(length(text) - length(replace(text, chr(10), '')) + 1 - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END AS INTEGER) AS last_line FROM documents")
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    head, size = F.element_at(F.split(text, "\n", -1), 1), F.octet_length(text)
    return read(spark, sf_dir, "documents").select("doc_id", F.length(head).cast("long").alias("head"), T.byte_slice(text, F.octet_length(head) + 1, size).alias("rest"), T.end_line(text, size).cast("int").alias("last_line"))


@query(
    "p4_merge_adjacent",
    """WITH RECURSIVE l AS (SELECT doc_id, s, n, coalesce(sum(strlen(s) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
   FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
 f AS (SELECT doc_id, CAST(b AS INTEGER) AS b, CAST(b + strlen(s) AS INTEGER) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM l WHERE s <> ''),
 r AS (SELECT doc_id, i, b AS start_byte, e, e - b AS held, 1 AS g FROM f WHERE i = 1
   UNION ALL SELECT r.doc_id, f.i, CASE WHEN r.held + f.e - f.b <= 750 THEN r.start_byte ELSE f.b END, f.e, CASE WHEN r.held + f.e - f.b <= 750 THEN r.held + f.e - f.b ELSE f.e - f.b END, CASE WHEN r.held + f.e - f.b <= 750 THEN r.g ELSE r.g + 1 END
   FROM r JOIN f ON f.doc_id = r.doc_id AND f.i = r.i + 1)
 SELECT doc_id, start_byte, max(e) AS end_byte, count(*) AS parts FROM r GROUP BY doc_id, g, start_byte""",
)
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chunking.lines(read(spark, sf_dir, "documents"), "doc_id", "text").where("content <> ''")
    span = F.struct("start_byte", "end_byte", F.concat(F.lit("l"), "line").alias("node_type"))
    merged = chunking.merged(lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans")), "doc_id", "spans")
    return merged.select("doc_id", "start_byte", "end_byte", F.size(F.split("node_type", "\\+")).cast("long").alias("parts"))


@query("p9_is_definition", "SELECT kind, regexp_matches(kind, 'class|function|method|constructor|declaration|definition') AS is_definition FROM (SELECT DISTINCT p_type || '_' || CASE p_size % 4 WHEN 0 THEN 'declaration' WHEN 1 THEN 'statement' WHEN 2 THEN 'class_body' ELSE 'call' END AS kind FROM part)")
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.concat("p_type", F.lit("_"), F.element_at(F.array(*map(F.lit, ("declaration", "statement", "class_body", "call"))), (F.col("p_size") % 4 + 1).cast("int")))
    return read(spark, sf_dir, "part").select(k.alias("kind")).distinct().select("kind", T.is_definition(F.col("kind")).alias("is_definition"))


@query("p2_chunk_documents")
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("file_path"), F.col("lang").alias("language"), F.col("text").alias("source"))
    return chunking.chunk_files(d)


# --- BM25 ---------------------------------------------------------------------------------------------------------------

TEXT = "the erth of doc_7 tion"


@query("a1_corpus_stats", f"WITH {BM25_TABLES} SELECT n_docs, round(avg_len, 6) AS avg_len FROM stats")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir)[1].corpus.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query("a2_term_df", f"WITH {BM25_TABLES} SELECT term, df FROM terms")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir)[1].terms


@query("a3_term_tf", f"WITH {BM25_TABLES} SELECT chunk_idx, term, tf, doc_len FROM postings JOIN sized USING (chunk_idx)")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir)[1].postings


def _topk(name: str, k1: float, b: float, where: str = "true", only=None) -> None:
    sql = f"WITH {BM25_TABLES}, q AS {s_terms(TEXT)}, scores AS ({s_score('q', k1, b, where)}) SELECT CAST(rank AS INTEGER) AS rank, chunk_idx, score FROM ({s_ranked('scores', 40)})"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = stored(spark, sf_dir, k1, b)
        return index.lexical_hits(TEXT, 40, None if only is None else index.chunks.where(only()).select("chunk_idx")).select("rank", "chunk_idx", "score")


_topk("k1_bm25_topk", 1.5, 0.75)
_topk("a4_bm25_params", 0.9, 0.4)
_topk("k2_bm25_filtered", 1.5, 0.75, "chunk_idx IN (SELECT chunk_idx FROM corpus WHERE file_path LIKE 'src/%')", lambda: F.startswith(F.col("file_path"), F.lit("src/")))


@query("k1_bm25_batch", f"WITH {BM25_TABLES}, q AS (SELECT item_id AS query_id, unnest({s_tokens('text')}) AS term FROM benchmark), scores AS ({s_score('q')}) SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_idx, score FROM ({s_ranked('scores', 10)})")
def k1_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = bm25.query_terms(read(spark, sf_dir, "benchmark"), "item_id", "text")
    return bm25.top_many(stored(spark, sf_dir).lexical, terms, 10)


@query(
    "c10_explain_bm25",
    f"""WITH {BM25_TABLES}, q AS {s_terms(TEXT)}, scores AS ({s_score('q')}), best AS ({s_ranked('scores', 15)}),
 hit AS (SELECT chunk_idx, score, doc_len, list(term || 'x' || tf) AS h, list(term) AS ts FROM best JOIN postings USING (chunk_idx) JOIN q USING (term) JOIN sized USING (chunk_idx) GROUP BY 1, 2, 3)
 SELECT chunk_idx, score, array_to_string(list_sort(h), ' ') AS hits, CAST(len(list_intersect(ts, {s_tokens(s_enrich("''", 'file_path'))})) AS INTEGER) AS path_hits, doc_len FROM hit JOIN corpus USING (chunk_idx)""",
)
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).explain(TEXT)


# --- vectors ------------------------------------------------------------------------------------------------------------

DIM = 64
IDS = [3, 17, 42, 99]


def _vector_sql(ids: str) -> str:
    return f"(SELECT list(x ORDER BY pos) AS qv FROM (SELECT pos, avg(x) AS x FROM (SELECT generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id IN ({ids})) GROUP BY pos))"


QVEC = f"qraw AS {_vector_sql(', '.join(map(str, IDS)))}, qvec AS (SELECT list_transform(qv, lambda x: x / sqrt(list_inner_product(qv, qv))) AS v FROM qraw)"


def _bags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, IDS)], "key int, ids array<long>")


def _qvec(spark: SparkSession, sf_dir: str) -> list[float]:
    model = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token_id"), "embedding")
    return V.encode(_bags(spark), model, DIM).first()["vector"]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_idx"), "embedding")


_DENSE = f"{QVEC}, dscores AS (SELECT 0 AS query_id, vec_id AS chunk_idx, round(list_inner_product(embedding::DOUBLE[], v), 9) AS score FROM embeddings, qvec WHERE round(list_inner_product(embedding::DOUBLE[], v), 9) > 0)"


@query("k3_dense_topk", f"WITH {_DENSE} SELECT CAST(rank AS INTEGER) AS rank, chunk_idx, score FROM ({s_ranked('dscores', 40)})")
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = plans.CodeIndex(spark, corpus(spark, sf_dir), None, _vectors(spark, sf_dir))
    return index.dense_hits(_qvec(spark, sf_dir), 40).select("rank", "chunk_idx", "score")


@query("k3_dense_bulk", f"WITH {_DENSE} SELECT chunk_idx, round(score, 6) AS score FROM dscores")
def k3_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.nearest(_vectors(spark, sf_dir), _qvec(spark, sf_dir)).where(F.round("score", 9) > 0).select("chunk_idx", F.round("score", 6).alias("score"))


@query("j6_dense_related", "WITH a AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS chunk_idx, round(list_inner_product(embedding::DOUBLE[], v::DOUBLE[]), 9) AS score FROM embeddings, a WHERE vec_id <> query_id AND round(list_inner_product(embedding::DOUBLE[], v::DOUBLE[]), 9) > 0) SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_idx, score FROM (" + s_ranked("s", 8) + ")")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector as a query against all, block by block."""
    v = _vectors(spark, sf_dir)
    return V.nearest_to_all(v, v.where("chunk_idx % 20 = 0"), 8)


def _doc_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.array(F.col("doc_id"), F.col("doc_id") * 7 % 600, F.col("doc_id") * 13 % 600, F.lit(-1).cast("long")).alias("ids"))


def _encode_sql(row: str, w: str) -> str:
    return f"""WITH n AS (SELECT count(*) AS n FROM embeddings), b AS (SELECT doc_id AS key, unnest([doc_id, doc_id * 7 % 600, doc_id * 13 % 600, -1]) AS id FROM documents),
 u AS (SELECT key, {w} AS w, {row} AS row FROM b, n JOIN embeddings k ON k.vec_id = b.id),
 x AS (SELECT key, w, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM u JOIN embeddings e ON e.vec_id = u.row),
 m AS (SELECT key, pos, sum(w * x) / count(*) AS x FROM x GROUP BY 1, 2), s AS (SELECT key, sqrt(sum(x * x)) AS norm FROM m GROUP BY 1)
 SELECT doc_id AS key, coalesce(round(max(CASE WHEN norm > 0 THEN x / norm ELSE 0 END) FILTER (pos = 1), 6), 0) + 0 AS v0, coalesce(round(sum(CASE WHEN norm > 0 THEN x / norm ELSE 0 END * pos), 5), 0) + 0 AS moment
 FROM documents LEFT JOIN m ON doc_id = m.key LEFT JOIN s ON doc_id = s.key GROUP BY doc_id"""


def _summary(v: DataFrame) -> DataFrame:
    moment = F.aggregate(F.zip_with("vector", F.sequence(F.lit(1), F.lit(DIM)), lambda x, i: x * i), F.lit(0.0), lambda a, b: a + b)
    return v.select("key", (F.round(F.element_at("vector", 1), 6) + 0).alias("v0"), (F.round(moment, 5) + 0).alias("moment"))


@query("v2_encode_mean_pool", _encode_sql("b.id", "1.0"))
def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token_id"), "embedding")
    return _summary(V.encode(_doc_bags(spark, sf_dir), model, DIM))


@query("v2_encode_sif_mapped", _encode_sql("n.n - 1 - b.id", "1.0 / (1 + b.id)"))
def v2_sif(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    n = F.broadcast(e.agg(F.count("*").alias("n")))
    model = e.crossJoin(n).select(F.col("vec_id").alias("token_id"), "embedding", (F.col("n") - 1 - F.col("vec_id")).alias("mapping"), (1.0 / (1 + F.col("vec_id"))).alias("sif"))
    return _summary(V.encode(_doc_bags(spark, sf_dir), model, DIM))


@query("v1_rows", "WITH i AS (SELECT doc_id AS id FROM documents UNION SELECT vec_id FROM embeddings) SELECT id, round(coalesce(embedding[1]::DOUBLE, 0), 6) AS v0, coalesce(len(embedding), 64) AS dim FROM i LEFT JOIN embeddings ON vec_id = id")
def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).union(read(spark, sf_dir, "embeddings").select("vec_id")).distinct()
    model = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token_id"), "embedding")
    return V.rows(ids, model, DIM).select("id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("v0"), F.size("embedding").cast("long").alias("dim"))


# --- fusion -------------------------------------------------------------------------------------------------------------


def s_blend(alpha: float, chunks: str = "corpus") -> str:
    """lex(chunk_idx, score, rank) and den likewise to c (file_path, start_line, chunk_idx, s, den_rank, lex_rank)."""
    return f"""u AS (SELECT 0 AS l, chunk_idx, score, rank FROM lex UNION ALL SELECT 1, chunk_idx, score, rank FROM den),
 per AS (SELECT file_path, start_line, u.chunk_idx, sum(CASE WHEN l = 0 THEN 1.0::DOUBLE / (60 + rank) ELSE 0 END) AS lx, sum(CASE WHEN l = 1 THEN 1.0::DOUBLE / (60 + rank) ELSE 0 END) AS dn, sum(score) AS total,
   coalesce(min(rank) FILTER (l = 0), 1073741824) AS lex_rank, coalesce(min(rank) FILTER (l = 1), 1073741824) AS den_rank FROM u JOIN {chunks} k ON k.chunk_idx = u.chunk_idx GROUP BY 1, 2, 3),
 pick AS (SELECT *, row_number() OVER (PARTITION BY file_path, start_line ORDER BY total DESC, lex_rank, den_rank, chunk_idx) AS n FROM per),
 c AS (SELECT file_path, start_line, max(chunk_idx) FILTER (n = 1) AS chunk_idx, round({alpha}::DOUBLE * sum(dn) + {1 - alpha}::DOUBLE * sum(lx), 12) AS s, min(den_rank) AS den_rank, min(lex_rank) AS lex_rank FROM pick GROUP BY 1, 2)"""


_TIE = "start_line, den_rank, lex_rank, chunk_idx"
S_COHERENCE = f"""h0 AS (SELECT *, max(s) OVER () AS top, sum(s) OVER (PARTITION BY file_path) AS fsum, row_number() OVER (PARTITION BY file_path ORDER BY s DESC, {_TIE}) AS n FROM c),
 h AS (SELECT file_path, start_line, chunk_idx, s + CASE WHEN n = 1 AND max(fsum) OVER () > 0 THEN 0.2::DOUBLE * top * fsum / max(fsum) OVER () ELSE 0 END AS s, den_rank, lex_rank FROM h0)"""
S_SATURATE = f"""pen AS (SELECT *, round(s * {s_penalty('file_path')}, 12) AS pen FROM b),
 sat AS (SELECT *, round(pen * pow(0.5, row_number() OVER (PARTITION BY file_path ORDER BY pen DESC, promoted, {_TIE}) - 1), 9) AS score FROM pen),
 best AS (SELECT *, row_number() OVER (ORDER BY score DESC, pen DESC, promoted, {_TIE}) AS rank FROM sat)"""


def _hits_sql(text: str, k: int, where: str = "true") -> str:
    return f"q AS {s_terms(text)}, scores AS ({s_score('q', where=where)}), lex AS ({s_ranked('scores', k)}), {_DENSE}, dsub AS (SELECT * FROM dscores JOIN corpus USING (chunk_idx) WHERE {where}), den AS ({s_ranked('dsub', k)})"


def _hits(spark: SparkSession, sf_dir: str, text: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    i = stored(spark, sf_dir)
    return i.lexical_hits(text, k), i.dense_hits(_qvec(spark, sf_dir), k), i.chunks


@query("j7_rrf_fuse", f"WITH {BM25_TABLES}, {_hits_sql(TEXT, 40)}, {s_blend(0.5)} SELECT file_path, start_line, chunk_idx, round(s, 9) AS s FROM c")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.blend(*_hits(spark, sf_dir, TEXT, 40), 0.5).select(*fusion.KEY, "chunk_idx", F.round("s", 9).alias("s"))


def _conversation_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = read(spark, sf_dir, "conversations")
    i = F.col("conv_id") * 1000 + F.col("turn")
    chunks = c.select(i.alias("chunk_idx"), F.concat(F.lit("conv/"), F.col("conv_id") % 40, F.lit("/talk.py")).alias("file_path"), F.col("turn").cast("int").alias("start_line"), (F.col("turn") + 1).cast("int").alias("end_line"), F.col("text").alias("content"))
    sized = c.select(i.alias("chunk_idx"), F.length("text").cast("double").alias("n"), F.octet_length("text").cast("double").alias("b"), F.lit(0).alias("query_id"))
    lex = bm25.ranked(sized.select("query_id", "chunk_idx", F.col("n").alias("score")), 200)
    den = bm25.ranked(sized.select("query_id", "chunk_idx", (F.col("b") % 997).alias("score")), 200)
    return lex.select("chunk_idx", "score", "rank"), den.select("chunk_idx", "score", "rank"), chunks


_CONV = f"""convs AS (SELECT conv_id * 1000 + turn AS chunk_idx, 'conv/' || (conv_id % 40) || '/talk.py' AS file_path, CAST(turn AS INTEGER) AS start_line, text AS content FROM conversations),
 ls AS (SELECT 0 AS query_id, chunk_idx, length(content)::DOUBLE AS score FROM convs), ds AS (SELECT 0 AS query_id, chunk_idx, (strlen(content) % 997)::DOUBLE AS score FROM convs),
 lex AS ({s_ranked('ls', 200)}), den AS ({s_ranked('ds', 200)}), {s_blend(0.5, 'convs')}"""


@query("a5_rrf_duplicate_keys", f"WITH {_CONV} SELECT file_path, start_line, chunk_idx, round(s, 9) AS s FROM c")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.blend(*_conversation_lists(spark, sf_dir), 0.5).select(*fusion.KEY, "chunk_idx", F.round("s", 9).alias("s"))


@query("w2_coherence", f"WITH {_CONV}, {S_COHERENCE} SELECT file_path, start_line, round(s, 9) AS s FROM h")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fusion.coherence(fusion.blend(*_conversation_lists(spark, sf_dir), 0.5))
    return c.select(*fusion.KEY, F.round("s", 9).alias("s"))


@query("w3_saturation", f"WITH {_CONV}, {S_COHERENCE}, b AS (SELECT *, 0 AS promoted FROM h), {S_SATURATE} SELECT file_path, start_line, score FROM sat")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fusion.coherence(fusion.blend(*_conversation_lists(spark, sf_dir), 0.5)).withColumn("promoted", F.lit(0))
    return fusion.saturate(c, True).select(*fusion.KEY, "score")


@query("k6_rerank_topk", f"WITH {_CONV}, {S_COHERENCE}, b AS (SELECT *, 0 AS promoted FROM h), {S_SATURATE} SELECT CAST(rank AS INTEGER) AS rank, chunk_idx, file_path, start_line, score FROM best WHERE rank <= 25")
def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.fuse(*_conversation_lists(spark, sf_dir), fusion.FusionOptions(top_k=25))
    return out.select("rank", "chunk_idx", "file_path", "start_line", "score")


@query("k5_plain_topk", f"WITH {_CONV} SELECT CAST(row_number() OVER (ORDER BY round(s, 9) DESC, {_TIE}) AS INTEGER) AS rank, chunk_idx, file_path, start_line, round(s, 9) AS score FROM c ORDER BY rank LIMIT 25")
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.fuse(*_conversation_lists(spark, sf_dir), fusion.FusionOptions(top_k=25, rerank=False))
    return out.select("rank", "chunk_idx", "file_path", "start_line", "score")


def s_define_boost(names: list[str], unit: float, near: str, before: str, out: str) -> str:
    """``before`` has top; gives ``out`` with the tiers of candidates and the promoted chunks."""
    return f"""own_{out} AS (SELECT x.file_path, x.start_line, x.chunk_idx, x.s + {unit}::DOUBLE * x.top * ({s_tier(names, 'k.content', 'x.file_path')}) AS s, den_rank, lex_rank, top, promoted FROM {before} x JOIN corpus k USING (chunk_idx)),
 new_{out} AS (SELECT k.file_path, k.start_line, k.chunk_idx, {unit}::DOUBLE * (SELECT max(top) FROM {before}) * ({s_tier(names, 'k.content', 'k.file_path')}) AS s, 1073741824 AS den_rank, 1073741824 AS lex_rank, (SELECT max(top) FROM {before}) AS top, 1 AS promoted,
   row_number() OVER (PARTITION BY k.file_path, k.start_line ORDER BY k.chunk_idx) AS n FROM corpus k WHERE ({near}) AND ({s_tier(names, 'k.content', 'k.file_path')}) > 0 AND NOT EXISTS (SELECT 1 FROM {before} x WHERE x.file_path = k.file_path AND x.start_line = k.start_line)),
 {out} AS (SELECT * FROM own_{out} UNION ALL SELECT * EXCLUDE (n) FROM new_{out} WHERE n = 1 AND s > 0)"""


_TOP = "t AS (SELECT *, max(s) OVER () AS top, 0 AS promoted FROM h)"
_K_STEM = f"lower({s_stem('k.file_path')})"


def s_near(name: str) -> str:
    bare = f"replace({_K_STEM}, '_', '')"
    return " OR ".join(f"{x} = '{name}'" for x in (_K_STEM, bare, f"rtrim({_K_STEM}, 's')", f"rtrim({bare}, 's')"))


def s_keyword_boost(words: list[str], before: str, out: str) -> str:
    ks = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    m = f"(len(list_filter({ks}, lambda k: list_contains(parts, k))) + len(list_filter({ks}, lambda k: NOT list_contains(parts, k) AND len(list_filter(parts, lambda p: least(length(p), length(k)) >= 3 AND (starts_with(p, k) OR starts_with(k, p)))) > 0))) / {float(len(words))}"
    return f"""p_{out} AS (SELECT *, {_S_PARTS} AS parts FROM {before}),
 {out} AS (SELECT file_path, start_line, chunk_idx, s + CASE WHEN {m} >= 0.1 THEN top * {m} ELSE 0 END AS s, den_rank, lex_rank, top, promoted FROM p_{out})"""


_RESULT = "SELECT CAST(rank AS INTEGER) AS rank, b.chunk_idx, b.file_path, b.start_line, k.end_line, round(score, 6) AS score, k.content FROM best b JOIN corpus k USING (chunk_idx)"


def _search(spark: SparkSession, sf_dir: str, text: str, k: int) -> DataFrame:
    """The distributed form of a search; c3_search_filtered, c4 and k4 take the one that goes by way of the driver."""
    lex, den, chunks = _hits(spark, sf_dir, text, 5 * k)
    out = fusion.fuse(lex, den, chunks, fusion.FusionOptions(top_k=k, query=text))
    return out.withColumn("score", F.round("score", 6))


SYMBOL = "Doc15Parser"
NATURAL = "where is the parser core of fooDoc Doc20Parser erth tion"
_WORDS = ["core", "doc20parser", "erth", "foodoc", "parser", "tion"]


@query("c3_search_text", f"WITH {BM25_TABLES}, {_hits_sql(TEXT, 40)}, {s_blend(0.5)}, {S_COHERENCE}, {_TOP}, {s_keyword_boost(['doc_7', 'erth', 'tion'], 't', 'b')}, {S_SATURATE} {_RESULT} WHERE rank <= 8")
def c3_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, TEXT, 8)


@query("c7_search_symbol", f"WITH {BM25_TABLES}, {_hits_sql(SYMBOL, 40)}, {s_blend(0.3)}, {S_COHERENCE}, {_TOP}, {s_define_boost([SYMBOL], 3.0, s_near(SYMBOL.lower()), 't', 'b')}, {S_SATURATE} {_RESULT} WHERE rank <= 8")
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, SYMBOL, 8)


_EMBED_NEAR = " OR ".join(f"'{s}' = {_K_STEM} OR '{s}' = replace({_K_STEM}, '_', '') OR (length({_K_STEM}) >= 4 AND starts_with('{s}', {_K_STEM})) OR (length(replace({_K_STEM}, '_', '')) >= 4 AND starts_with('{s}', replace({_K_STEM}, '_', '')))" for s in ("doc20parser", "foodoc"))


@query("c9_search_natural", f"WITH {BM25_TABLES}, {_hits_sql(NATURAL, 40)}, {s_blend(0.5)}, {S_COHERENCE}, {_TOP}, {s_keyword_boost(_WORDS, 't', 'w')}, {s_define_boost(['Doc20Parser', 'fooDoc'], 1.5, _EMBED_NEAR, 'w', 'b')}, {S_SATURATE} {_RESULT} WHERE rank <= 8")
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, NATURAL, 8)


FILTER = ["src/src0/doc_0_parser.py", "src/core/src10/doc_10_parser.py", "examples/src0/doc_0_parser.py", "tests/src5/doc_25_parser.py"]
_F_WHERE = "chunk_idx IN (SELECT chunk_idx FROM corpus WHERE file_path IN (" + ", ".join(f"'{x}'" for x in FILTER) + "))"


@query("c3_search_filtered", f"WITH {BM25_TABLES}, {_hits_sql(TEXT, 40, _F_WHERE)}, {s_blend(0.5)}, {S_COHERENCE}, {_TOP}, {s_keyword_boost(['doc_7', 'erth', 'tion'], 't', 'b')}, {S_SATURATE} SELECT file_path, start_line, end_line, score, content FROM ({_RESULT} WHERE rank <= 8)")
def c3_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).search(TEXT, 8, FILTER, vector=_qvec(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("t21_filter_backslashes", f"WITH {BM25_TABLES}, {_hits_sql(TEXT, 40, _F_WHERE)}, {s_blend(0.5)}, {S_COHERENCE}, {_TOP}, {s_keyword_boost(['doc_7', 'erth', 'tion'], 't', 'b')}, {S_SATURATE} SELECT file_path, start_line, end_line, score, content FROM ({_RESULT} WHERE rank <= 8)")
def t21(spark: SparkSession, sf_dir: str) -> DataFrame:
    backslashed = [p.replace("/", "\\") for p in FILTER]
    return stored(spark, sf_dir).search(TEXT, 8, backslashed, vector=_qvec(spark, sf_dir)).withColumn("score", F.round("score", 6))


def _interactive(name: str, text: str, boosts: str) -> None:
    @query(name, f"WITH {BM25_TABLES}, {_hits_sql(text, 40)}, {s_blend(0.3 if fusion.is_symbol(text) else 0.5)}, {S_COHERENCE}, {_TOP}, {boosts}, {S_SATURATE} SELECT file_path, start_line, end_line, score, content FROM ({_RESULT} WHERE rank <= 8)")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stored(spark, sf_dir).search(text, 8, vector=_qvec(spark, sf_dir)).withColumn("score", F.round("score", 6))


_interactive("c3_index_search_text", TEXT, s_keyword_boost(["doc_7", "erth", "tion"], "t", "b"))
_interactive("c7_index_search_symbol", SYMBOL, s_define_boost([SYMBOL], 3.0, s_near(SYMBOL.lower()), "t", "b"))
_interactive("c9_index_search_natural", NATURAL, f"{s_keyword_boost(_WORDS, 't', 'w')}, {s_define_boost(['Doc20Parser', 'fooDoc'], 1.5, _EMBED_NEAR, 'w', 'b')}")


@query("s17_result_json", f"WITH {BM25_TABLES}, {_hits_sql(TEXT, 40)}, {s_blend(0.5)}, {S_COHERENCE}, {_TOP}, {s_keyword_boost(['doc_7', 'erth', 'tion'], 't', 'b')}, {S_SATURATE} SELECT CAST(to_json({{file_path: file_path, start_line: start_line, end_line: end_line, score: score, content: content}}) AS VARCHAR) AS json FROM ({_RESULT} WHERE rank <= 8)")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.as_json(_search(spark, sf_dir, TEXT, 8))


@query("s18_format_results", f"WITH {BM25_TABLES}, {_hits_sql(TEXT, 40)}, {s_blend(0.5)}, {S_COHERENCE}, {_TOP}, {s_keyword_boost(['doc_7', 'erth', 'tion'], 't', 'b')}, {S_SATURATE} SELECT printf('%s:%d-%d score=%.4f', file_path, start_line, end_line, score) AS line FROM ({_RESULT} WHERE rank <= 8)")
def s18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.formatted(_search(spark, sf_dir, TEXT, 8))


@query(
    "j5_anchor_lookup",
    "WITH a AS (SELECT item_id, 'conv/' || (item_id % 40) AS file_path, item_id % 9 AS line FROM benchmark), k AS (SELECT conv_id * 1000 + turn AS chunk_idx, 'conv/' || (conv_id % 40) AS file_path, turn * 2 AS lo, turn * 2 + 3 AS hi FROM conversations) SELECT item_id, min(chunk_idx) AS chunk_idx FROM a JOIN k USING (file_path) WHERE line BETWEEN lo AND hi GROUP BY item_id",
)
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("place"), F.concat(F.lit("conv/"), F.col("item_id") % 40).alias("file_path"), (F.col("item_id") % 9).alias("line"))
    t = F.col("turn")
    k = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + t).alias("chunk_idx"), F.concat(F.lit("conv/"), F.col("conv_id") % 40).alias("file_path"), (t * 2).alias("start_line"), (t * 2 + 3).alias("end_line"))
    return plans.anchors(k, a).select(F.col("place").alias("item_id"), "chunk_idx")


ANCHOR = "src/src0/doc_0_parser.py"
_M = "(len(list_filter(ks, lambda k: list_contains(parts, k))) + len(list_filter(ks, lambda k: NOT list_contains(parts, k) AND len(list_filter(parts, lambda p: least(length(p), length(k)) >= 3 AND (starts_with(p, k) OR starts_with(k, p)))) > 0))) / len(ks)::DOUBLE"


@query(
    "c4_find_related",
    f"""WITH {BM25_TABLES}, anchor AS (SELECT chunk_idx AS me, content AS text FROM corpus WHERE file_path = '{ANCHOR}' AND 0 BETWEEN start_line AND end_line ORDER BY chunk_idx LIMIT 1),
 q AS (SELECT 0 AS query_id, unnest(list_distinct(tokens)) AS term FROM tokens, anchor WHERE chunk_idx = me), scores AS ({s_score('q')}), most AS ({s_ranked('scores', 41)}),
 others AS (SELECT query_id, chunk_idx, score FROM most, anchor WHERE chunk_idx <> me), lex AS ({s_ranked('others', 41)}),
 dscores AS (SELECT 0 AS query_id, e.vec_id AS chunk_idx, round(list_inner_product(e.embedding::DOUBLE[], a.embedding::DOUBLE[]), 9) AS score FROM embeddings e, embeddings a, anchor WHERE a.vec_id = me AND e.vec_id <> me AND e.vec_id IN (SELECT chunk_idx FROM corpus)),
 dsub AS (SELECT * FROM dscores WHERE score > 0), den AS ({s_ranked('dsub', 41)}),
 {s_blend(0.5)}, {S_COHERENCE}, {_TOP}, kw AS (SELECT {_S_KEYWORDS} AS ks FROM anchor), p_w AS (SELECT t.*, {_S_PARTS} AS parts, ks FROM t, kw),
 w AS (SELECT file_path, start_line, chunk_idx, s + CASE WHEN {_M} >= 0.1 THEN top * {_M} ELSE 0 END AS s, den_rank, lex_rank, top, promoted FROM p_w),
 {s_define_boost(["Doc0Parser"], 1.5, f"k.chunk_idx <> (SELECT me FROM anchor) AND ('doc0parser' = {_K_STEM} OR 'doc0parser' = replace({_K_STEM}, '_', '') OR (length({_K_STEM}) >= 4 AND starts_with('doc0parser', {_K_STEM})) OR (length(replace({_K_STEM}, '_', '')) >= 4 AND starts_with('doc0parser', replace({_K_STEM}, '_', ''))))", "w", "b")},
 {S_SATURATE} SELECT file_path, start_line, end_line, score, content FROM ({_RESULT} WHERE rank <= 8)""",
)
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).find_related(ANCHOR, 0, 8).withColumn("score", F.round("score", 6))


@query("u5_path_overlap", f"WITH {BM25_TABLES}, q AS {s_terms(TEXT)}, scores AS ({s_score('q')}), a AS ({s_ranked('scores', 40)}), s2 AS ({s_score('q', 0.9, 0.4)}), b AS ({s_ranked('s2', 40)}), x AS (SELECT list(DISTINCT file_path) AS x FROM a JOIN corpus USING (chunk_idx)), y AS (SELECT list(DISTINCT file_path) AS y FROM b JOIN corpus USING (chunk_idx)) SELECT len(list_intersect(x, y)) / greatest(len(x), len(y))::DOUBLE AS overlap FROM x, y")
def u5(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (i.chunks.join(F.broadcast(i.lexical_hits(TEXT, 40)), "chunk_idx") for i in (stored(spark, sf_dir), stored(spark, sf_dir, 0.9, 0.4)))
    return plans.overlap(a, b)


@query("a9_percentile", "WITH v AS (SELECT list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL) SELECT v[CAST(floor((len(v) - 1) * 0.5 + 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor((len(v) - 1) * 0.95 + 0.5) AS BIGINT) + 1] AS p95 FROM v")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.percentiles(read(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95})


# --- cache, codec, WordPiece --------------------------------------------------------------------------------------------


@query(
    "j11_cache_hit_miss",
    "WITH f AS (SELECT url AS path, page_id AS mtime, strlen(html) AS size FROM pages), c AS (SELECT url AS path, page_id + CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS mtime, strlen(html) + CASE WHEN page_id % 11 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN page_id % 13 = 0 OR page_id % 5 = 0 THEN 1 ELSE 2 END AS v FROM pages) SELECT f.path, f.mtime, EXISTS (SELECT 1 FROM c WHERE c.path = f.path AND c.mtime = f.mtime AND c.size = f.size AND c.v = 2) AS hit FROM f",
)
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = read(spark, sf_dir, "pages"), F.col("page_id")
    size = F.octet_length("html").cast("long")
    one = lambda k: F.when(i % k == 0, 1).otherwise(0)
    files = p.select(F.col("url").alias("path"), i.alias("mtime_ms"), size.alias("size"))
    held = p.select(F.col("url").alias("path"), (i + one(7)).alias("mtime_ms"), (size + one(11)).alias("size"), F.array().cast(store.CHUNKS).alias("chunks"), (2 - F.greatest(one(13), one(5))).alias("v"))
    kept = store.ChunkStore(spark, f"{store.shared_folder(spark)}/chunks-{uuid.uuid4().hex}")
    for v in (chunking.VERSION - 1, chunking.VERSION):
        kept.add(held.where(F.col("v") == v), v)
    hits, misses = kept.split(files)
    found = hits.select("path", "mtime_ms", F.lit(True).alias("hit")).unionByName(misses.select("path", "mtime_ms", F.lit(False).alias("hit")))
    return found.withColumnRenamed("mtime_ms", "mtime")


@query("s12_chunk_codec", f"WITH {CORPUS} SELECT file_path, language, start_line, end_line, 0 AS start_byte, CAST(strlen(content) AS INTEGER) AS end_byte, content, 'text' AS node_type, false AS is_definition FROM corpus")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).withColumns({"start_byte": F.lit(0), "end_byte": F.octet_length("content"), "node_type": F.lit("text"), "is_definition": F.lit(False)})
    return store.from_json(store.to_json(c))


def pieces() -> WordPiece:
    """A small vocabulary: letters, some syllables and continuations."""
    units = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz", "the", "tion", "er", "re", "th", "en", "que", "de", "la", ".", ","]
    units += [f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"] + ["##tion", "##er", "##th", "##en", "##ea", "##and"]
    return WordPiece({u: i for i, u in enumerate(units)}, 1, {}, True)


@query("t5_wordpiece_words", "SELECT item_id, array_to_string(regexp_extract_all(text, '[!-/:-@\\[-`\\{-~]|[^\\x{09}-\\x{0D}\\x{20}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}!-/:-@\\[-`\\{-~]+'), ' ') AS words FROM benchmark")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import wordpiece

    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(wordpiece.words(F.col("text")), " ").alias("words"))


def _wordpiece_sql() -> str:
    p = pieces()
    vocab = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in p.vocab.items()) + ") v(tok, id)"
    return f"""WITH RECURSIVE v AS (SELECT tok, id FROM {vocab}),
 w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[!-/:-@\\[-`\\{{-~]|[^\\x{{09}}-\\x{{0D}}\\x{{20}}!-/:-@\\[-`\\{{-~]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[!-/:-@\\[-`\\{{-~]|[^\\x{{09}}-\\x{{0D}}\\x{{20}}!-/:-@\\[-`\\{{-~]+'), 1) AS n FROM benchmark),
 d AS (SELECT DISTINCT w FROM w),
 r AS (SELECT w, 1 AS pos, []::INTEGER[] AS ids, false AS bad FROM d
   UNION ALL SELECT r.w, r.pos + coalesce(m.len, 100000), CASE WHEN m.id IS NULL THEN [1] ELSE list_append(r.ids, m.id) END, m.id IS NULL FROM r
   LEFT JOIN LATERAL (SELECT id, length(replace(tok, '##', '')) AS len FROM v WHERE (r.pos = 1 AND tok NOT LIKE '##%' AND starts_with(substr(r.w, r.pos), tok)) OR (r.pos > 1 AND tok LIKE '##%' AND starts_with(substr(r.w, r.pos), substr(tok, 3))) ORDER BY len DESC LIMIT 1) m ON true
   WHERE r.pos <= length(r.w) AND NOT r.bad),
 f AS (SELECT w, ids FROM r WHERE pos > length(w))
 SELECT item_id, array_to_string(flatten(list(ids ORDER BY n)), ' ') AS ids FROM w JOIN f USING (w) GROUP BY item_id"""


@query("t7_wordpiece_ids", _wordpiece_sql())
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(token_ids(F.col("text"), pieces()), " ").alias("ids"))
