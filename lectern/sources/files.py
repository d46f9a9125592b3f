"""Text, directory, lexicon, CSV and stand-off sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: null words of the annotation files
NULL_WORDS = ("NA", "N/A", "No Label", "none", "None", "")


def texts(spark: SparkSession, path: str, glob: str = "*.[tT][xX][tT]", recursive: bool = True) -> DataFrame:
    """One row per file: path, text with line breaks and tabs as blanks; blank files give null."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=recursive)
    clean = F.translate("value", "\n\t", "  ")
    return df.select(F.input_file_name().alias("path"), F.when(F.trim(clean) != "", clean).alias("text"))


def binaries(spark: SparkSession, path: str, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """path, length, upper hex digest of each file."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return df.select("path", "length", F.upper(F.md5("content")).alias("md5"))


def lines(text: DataFrame) -> DataFrame:
    return text.select("*", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def term_list(spark: SparkSession, paths: str | list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """One term a line; comments after #; the union of several files without the skipped terms."""
    t = spark.read.text(paths).select(F.trim(F.regexp_replace("value", r"\s*#.*$", "")).alias("term"))
    return t.where(F.col("term") != "").where(~F.col("term").isin(*skip) if skip else F.lit(True)).distinct()


def idf_table(spark: SparkSession, path: str) -> DataFrame:
    """term, idf; tab separated, gz is transparent."""
    return spark.read.csv(path, sep="\t", schema="term string, idf double").where("term is not null and idf is not null")


def annotation_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Positional columns, doubled quotes, null words read as null."""
    df = spark.read.csv(path, schema=schema, header=header, quote='"', escape='"', multiLine=True, mode="PERMISSIVE")
    clean = {c: F.when(~F.trim(c).isin(*NULL_WORDS), F.col(c)) for c, t in df.dtypes if t == "string"}
    return df.withColumns(clean)


#: positional columns of the annotation files
SCHEMAS = {
    "codes_applied": "annotation_id string, annotator_id string, code string, was_present string, label string",
    "references": "annotation_id string, referred string, doc_id string, reference string, annotator_id string, page string, ref_type string",
    "in_text_mentions": "annotation_id string, annotator_id string, doc_id string, quote string, full_quote string, page int, type string, certainty int, memo string",
    "articles": "doc_id string, article_set string, annotator_id string, no_selections string, unused_1 string, unused_2 string",
}


def annotation_table(spark: SparkSession, path: str, name: str, header: bool = True) -> DataFrame:
    """One of the four annotation files: typed columns, null words as null, flags (was_present, no_selections) as booleans."""
    df = annotation_csv(spark, path, SCHEMAS[name], header)
    flags = [c for c in ("was_present", "no_selections") if c in df.columns]
    return df.withColumns({c: F.coalesce(F.upper(F.trim(c)) == "TRUE", F.lit(False)) for c in flags}) if flags else df


def languages(spark: SparkSession, path: str) -> DataFrame:
    """key (lower case), name, wikipedia_url, wikidata_id; of several rows of one name the one with the smallest id."""
    df = spark.read.csv(path, schema="name string, wikipedia_url string, wikidata_id string").where("trim(name) <> ''")
    return df.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min(F.struct("wikidata_id", "name", "wikipedia_url")).alias("x")).select("key", F.trim("x.name").alias("name"), "x.wikipedia_url", "x.wikidata_id")


def property_values(spark: SparkSession, path: str, column: str = "value") -> DataFrame:
    """Lower-case values of a property or category list, each once."""
    return term_list(spark, path).select(F.lower("term").alias(column)).distinct()


def usage_corrections(spark: SparkSession, path: str) -> DataFrame:
    """id, resp, used; rows of another arity are dropped."""
    parts = spark.read.text(path).select(F.split("value", ",").alias("p")).where("size(p) = 3")
    return parts.select(F.trim(F.col("p")[0]).alias("id"), F.trim(F.col("p")[1]).alias("resp"), (F.upper(F.trim(F.col("p")[2])) == "TRUE").alias("used"))


def first_comma(spark: SparkSession, path: str) -> DataFrame:
    """id, title; only the first comma separates."""
    p = spark.read.text(path).select(F.split("value", ",", 2).alias("p")).where("size(p) = 2")
    return p.select(F.trim(F.col("p")[0]).alias("id"), F.trim(F.col("p")[1]).alias("title"))


def standoff(spark: SparkSession, path: str) -> DataFrame:
    """file, id, type, start, end, chunk of .ann files; relations are dropped."""
    v = spark.read.option("pathGlobFilter", "*.ann").text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.ann$", 1).alias("file"), F.split("value", "\t").alias("t")).where("size(t) >= 3 and not startswith(t[0], 'R')")
    s = F.split(F.col("t")[1], " ")
    rows = v.select("file", F.col("t")[0].alias("id"), s[0].alias("type"), F.expr("try_cast(split(t[1], ' ')[1] as int)").alias("start"), F.expr("try_cast(element_at(split(t[1], ' '), -1) as int)").alias("end"), F.col("t")[2].alias("chunk"))
    return rows.where("start is not null and end is not null")


def linking_response(df: DataFrame, column: str = "response") -> DataFrame:
    """Entities of a linking service's answer with a map of their statements."""
    schema = "language struct<lang:string>, entities array<struct<offsetStart:int,confidence_score:double,wikipediaExternalRef:int,wikidataId:string,statements:array<struct<propertyId:string,value:string>>>>"
    r = df.withColumn("r", F.from_json(column, schema)).select(*df.columns, F.col("r.language.lang").alias("lang"), F.explode("r.entities").alias("e"))
    grouped = F.aggregate(
        F.coalesce("e.statements", F.array()),
        F.expr("cast(map() as map<string, array<string>>)"),
        lambda m, s: F.map_zip_with(m, F.create_map(s["propertyId"], F.array(s["value"])), lambda k, a, b: F.concat(F.coalesce(a, F.expr("cast(array() as array<string>)")), F.coalesce(b, F.expr("cast(array() as array<string>)")))),
    )
    return r.select(*df.columns, "lang", F.col("e.offsetStart").alias("start"), F.col("e.confidence_score").alias("score"), F.col("e.wikidataId").alias("wikidata_id"), F.when(F.col("e.wikipediaExternalRef") != -1, F.col("e.wikipediaExternalRef")).alias("wikipedia_ref"), grouped.alias("statements"))
