"""Readers of files and logs, and what has been read before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Searches and user ratings stand in one log; rows of either kind lack the other's fields.
FEEDBACK = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("query_type", T.StringType()),
    T.StructField("num_results", T.LongType()),
    T.StructField("expanded_query", T.StringType()),
    T.StructField("expansion_count", T.LongType()),
    T.StructField("top_results", T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("filing_type", T.StringType()), T.StructField("filing_date", T.StringType()), T.StructField("section", T.StringType()), T.StructField("preview", T.StringType())]))),
    T.StructField("user_rating", T.LongType()),
    T.StructField("user_selected_indices", T.ArrayType(T.LongType())),
])
MANIFEST = "path string, hash string"


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, hash, content, modified): whole files, hashed by the tasks that read them."""
    read = spark.read.format("binaryFile").load(pattern)
    return read.select("path", F.md5("content").alias("hash"), "content", F.col("modificationTime").alias("modified"))


def listing(spark: SparkSession, patterns: dict[str, str]) -> DataFrame:
    """(source, path, name, modified, bytes) of the files that each source's pattern names; their content isn't read, and empty files are left out."""
    from functools import reduce

    each = lambda source, pattern: spark.read.format("binaryFile").load(pattern).select(F.lit(source).alias("source"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    return reduce(DataFrame.unionByName, (each(*x) for x in patterns.items()))


def inventory(listed: DataFrame) -> DataFrame:
    """(source, files, bytes, newest) of a listing, and of all sources together (null)."""
    return listed.rollup("source").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.max("modified").alias("newest"))


def write_texts(rendered: DataFrame, at: str, path_col: str = "path", text_col: str = "text") -> None:
    """Writes each rendered text as a file of its own, in a folder named by its path's value."""
    rendered.select(path_col, text_col).write.mode("overwrite").partitionBy(path_col).text(at, lineSep="\n")


def texts(frame: DataFrame) -> DataFrame:
    """Files with their content as text; bytes that aren't UTF-8 become the replacement character."""
    return frame.withColumn("text", F.decode("content", "utf-8")).drop("content")


def manifest(spark: SparkSession, at: str) -> DataFrame:
    """What an index holds; empty where there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(MANIFEST).parquet(at)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def first_format(html, xml, text):
    """The first content that isn't empty, with its kind."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.struct(F.coalesce(filled(html), filled(xml), filled(text)).alias("content"), F.when(filled(html).isNotNull(), "html").when(filled(xml).isNotNull(), "xml").when(filled(text).isNotNull(), "txt").alias("kind"))


def to_fetch(offered: DataFrame, known: DataFrame, years: int = 3, start: str | None = None, end: str | None = None) -> DataFrame:
    """Filings to fetch (ticker, filing_type, filing_date, accession): within the days given, or else the newest of each type as the years have; not those known."""
    from pyspark.sql import Window

    if start or end:
        chosen = offered.where(F.col("filing_date").between(F.lit(start or "0001-01-01").cast("date"), F.lit(end or "9999-12-31").cast("date")))
    else:
        per_year = F.create_map(*(F.lit(x) for pair in {"10-K": 1, "10-Q": 3, "8-K": 10, "DEF 14A": 1, "4": 20}.items() for x in pair))
        most = F.coalesce(F.try_element_at(per_year, F.col("filing_type")), F.lit(5)) * years
        nth = F.row_number().over(Window.partitionBy("ticker", "filing_type").orderBy(F.desc("filing_date"), "accession"))
        chosen = offered.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")
    return chosen.join(known.select("accession"), "accession", "left_anti")


def since(offered: DataFrame, known: DataFrame, date_col: str = "filing_date") -> DataFrame:
    """What is offered from the day of the newest known on; all of it where nothing is known."""
    mark = known.agg(F.max(F.col("last_updated").cast("date")).alias("mark"))
    return offered.crossJoin(F.broadcast(mark)).where(F.col("mark").isNull() | (F.col(date_col) >= F.col("mark"))).drop("mark")


def feedback(spark: SparkSession, at: str) -> DataFrame:
    """Searches of a feedback log; ratings have no mode and are left out."""
    return spark.read.schema(FEEDBACK).json(at).where("mode IS NOT NULL")


def log_searches(searches: DataFrame, at: str) -> None:
    """Appends searches with at most ten results, previews of 200 characters and rounded scores."""
    cut = F.transform(F.slice("top_results", 1, 10), lambda r: r.withField("preview", F.when(F.length(r["preview"]) > 200, F.concat(F.substring(r["preview"], 1, 200), F.lit("..."))).otherwise(r["preview"])).withField("score", F.bround(r["score"], 4)))
    searches.withColumn("top_results", cut).write.mode("append").json(at)


def log_ratings(ratings: DataFrame, at: str) -> None:
    """Appends what users say of results (query, user_rating[, user_selected_indices]) to the log of searches."""
    given = [c for c in ("timestamp", "ticker", "query", "user_rating", "user_selected_indices") if c in ratings.columns]
    ratings.select(*given, F.lit("user_feedback").alias("type")).write.mode("append").json(at)


def questions(frame: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, section, id, depth, status, question, answer) of Markdown question files; comments are stripped, bad blocks left out."""
    bare = frame.select(path_col, F.regexp_replace(text_col, r"(?s)<!--.*?-->", "").alias("_t"))
    section = F.trim(F.regexp_extract("_t", r"(?m)^section:[ \t]*(.+)$", 1))
    blocks = bare.where(F.length(section) > 0).select(path_col, section.alias("section"), F.explode(F.slice(F.split("_t", r"(?m)^## (?=Q\d)"), 2, 1_000_000)).alias("_b"))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("_b", rf"(?m)^\*\*{name}:\*\*[ \t]*(.+)$", 1)), F.lit(""))
    out = blocks.select(path_col, "section", F.regexp_extract("_b", r"^(Q\d+\.\d+)", 1).alias("id"), F.coalesce(F.lower(field("Depth")), F.lit("medium")).alias("depth"), F.coalesce(F.lower(field("Status")), F.lit("pending")).alias("status"), field("Question").alias("question"), F.nullif(F.trim(F.regexp_extract("_b", r"(?s)\*\*Answer:\*\*(.*?)(?:\n\*\*|\n---|$)", 1)), F.lit("")).alias("answer"))
    return out.where((F.length("id") > 0) & F.col("question").isNotNull())


#: Counts of questions by their status, as a manifest has them.
_COUNTS = ("question_count", "pending", "in_progress", "answered", "errors", "needs_deeper", "incomplete")


def question_manifests(texts: DataFrame, id_col: str = "path", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sections, hashes) of manifests of question files, one a row: (id, ticker, file, counts) and (id, hash, file, question).

    Hashes stand in a map (hash to file and question) or, in older manifests, in a list of triples, which may be empty; both give the same rows.
    What is missing is zero or null, and a text that is no JSON has no rows.
    """
    read = texts.select(F.col(id_col).alias("_id"), F.try_parse_json(text_col).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    entry = "struct<" + ",".join(f"{c}:bigint" for c in _COUNTS) + ">"
    per_file = read.select("_id", get("$.ticker", "string").alias("ticker"), F.explode(get("$.sections", f"map<string,{entry}>")).alias("file", "s"))
    sections = per_file.select(F.col("_id").alias(id_col), "ticker", "file", *(F.coalesce(F.col(f"s.{c}"), F.lit(0)).alias(c) for c in _COUNTS))
    of_map = F.transform(F.map_entries(get("$.question_hashes", "map<string,array<string>>")), lambda e: F.struct(e["key"].alias("hash"), e["value"][0].alias("file"), e["value"][1].alias("question")))
    of_list = F.transform(get("$.question_hashes", "array<array<string>>"), lambda e: F.struct(e[0].alias("hash"), e[1].alias("file"), e[2].alias("question")))
    hashes = read.select("_id", F.explode(F.coalesce(of_map, of_list)).alias("h")).select(F.col("_id").alias(id_col), "h.*")
    return sections, hashes


def refreshed_manifest(asked: DataFrame, ticker: str, path_col: str = "path") -> DataFrame:
    """(text) of the manifest of question files (path, id, status, question), all counts and hashes made anew."""
    from tessera.functions.text import question_key

    named = {"pending": "pending", "in_progress": "in_progress", "answered": "answered", "errors": "error", "needs_deeper": "needs_deeper", "incomplete": "incomplete"}
    counts = asked.groupBy(path_col).agg(F.count(F.lit(1)).alias("question_count"), *(F.count_if(F.lower("status") == word).alias(c) for c, word in named.items()))
    sections = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(path_col).alias("key"), F.struct(*_COUNTS).alias("value"))))).alias("sections"))
    first = asked.groupBy(question_key(F.col("question")).alias("key")).agg(F.min(F.struct(path_col, "id")).alias("at"))
    hashes = first.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.array(f"at.{path_col}", "at.id").alias("value"))))).alias("question_hashes"))
    return sections.crossJoin(hashes).select(F.to_json(F.struct(F.lit(ticker).alias("ticker"), "sections", "question_hashes")).alias("text"))
