"""Chunking of texts: sliding windows and sections as expressions, packing of paragraphs as a fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How lines begin sections. Letter case does not matter.
SECTION_STARTS = (
    r"^\s*\d+\.\s+[A-ZÀ-ɏЀ-ӿ]", r"^\s*\d+\.\d+\.\s*", r"^\s*\d+\.\d+\.\d+\.\s*", r"^\s*\d+\.\d+\.\d+\.\d+\.\s*", r"^\s*\w+\s+\d+[:\.]?\s*$",
    r"^\s*\([a-zA-Z]\)\s*", r"^\s*\(\d+\)\s*", r"^\s*[A-Z]\.\s+", r"^\s*[IVX]+\.\s+",
)
SIZE, OVERLAP, MOST, LEAST = 800, 200, 1200, 100


def sliding(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of the text as an array of (index, start, text); none for an empty text. The last one ends the text."""
    n, step = F.length(text), size - overlap
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("index"), (i * step).alias("start"), F.substring(text, i * step + 1, F.lit(size)).alias("text")))
    return F.when(n > 0, made).otherwise(F.slice(made, 1, 0))


def starts_section(line: Column) -> Column:
    return line.rlike("(?iU)" + "|".join(f"(?:{p})" for p in SECTION_STARTS))


def is_start(line: Column) -> Column:
    from ..functions.text import is_heading

    return starts_section(line) | is_heading(line)


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, title, text): lines from one that starts a section up to the next. The title is the first 100
    characters of that line; lines before the first start have none."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("i", "line"))
    lines = lines.withColumn("s", F.trim("line")).withColumn("new", (F.length("s") > 0) & is_start(F.trim("line")))
    lines = lines.withColumn("section", F.sum(F.col("new").cast("int")).over(Window.partitionBy("id").orderBy("i")))
    # blank lines before anything else are dropped
    grouped = lines.groupBy("id", "section").agg(
        F.max(F.when(F.col("new") & (F.length("s") < 200), F.substring("s", 1, 100))).alias("title"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l")
    )
    body = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    return grouped.select(F.col("id").alias(id_col), "section", "title", body.alias("text")).where(F.length("text") > 0)


def pack_paragraphs(text: Column, most: int = MOST) -> Column:
    """Paragraphs (parted by blank lines) joined up to ``most`` characters; a longer one stays whole."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")

    def add(acc: Column, p: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))
        fits = (F.size(acc) > 0) & (F.length(last) + F.length(p) + 2 <= most)
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n\n"), p)))
        return F.when(fits, longer).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(parts, F.slice(parts, 1, 0), add)


def structured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, least: int = LEAST) -> DataFrame:
    """(id, index, title, text): sections, those over ``most`` packed by paragraphs; a text under ``least`` is one chunk."""
    short = docs.where(F.length(text_col) < least).select(F.col(id_col), F.lit(0).alias("section"), F.lit(None).cast("string").alias("title"), F.col(text_col).alias("text"))
    found = short.unionByName(sections(docs.where(F.length(text_col) >= least), id_col, text_col))
    parts = F.when(F.length("text") > most, pack_paragraphs(F.col("text"), most)).otherwise(F.array("text"))
    cut = found.select(id_col, "section", "title", F.posexplode(parts).alias("p", "text"))
    index = F.row_number().over(Window.partitionBy(id_col).orderBy("section", "p")) - 1
    return cut.select(id_col, index.alias("index"), "title", "text")


def merge_titles(chunks: Column, below: int = 50) -> Column:
    """An ordered array of (title, text): a titled chunk under ``below`` characters is put before the next one, which
    is then kept as it is."""

    def add(acc: Column, c: Column) -> Column:
        held = acc["held"]
        joined = F.struct(F.coalesce(held["title"], c["title"]).alias("title"), F.when(held.isNull(), c["text"]).otherwise(F.concat(F.trim(held["text"]), F.lit("\n"), c["text"])).alias("text"))
        hold = held.isNull() & (F.length(c["text"]) < below) & c["title"].isNotNull()
        return F.struct(F.when(hold, c).alias("held"), F.when(hold, acc["out"]).otherwise(F.concat(acc["out"], F.array(joined))).alias("out"))

    plain = F.transform(chunks, lambda c: F.struct(c["title"].alias("title"), c["text"].alias("text")))
    zero = F.struct(F.try_element_at(F.slice(plain, 1, 0), F.lit(1)).alias("held"), F.slice(plain, 1, 0).alias("out"))
    done = F.aggregate(plain, zero, add)
    return F.concat(done["out"], F.when(done["held"].isNotNull(), F.array(done["held"])).otherwise(F.slice(plain, 1, 0)))
