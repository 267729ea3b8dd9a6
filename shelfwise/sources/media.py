"""Reading a library from storage: file listings, kinds, embedded text, sidecar files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.ordering import estimated_bytes, with_position

# Extensions of pictures and of videos, and names that are passed over.
IMAGES = ["jpg", "jpeg", "jpe", "png", "gif", "webp", "tif", "tiff", "bmp", "avif"]
VIDEOS = ["mp4", "m4v", "mov", "webm"]
PASSED_OVER = ["$recycle.bin", "#recycle", "@recycle"]
HEAD = 256 * 1024
CAPTION_MOST = 2000


def kind(path: Column) -> Column:
    """0 for a picture, 1 for a video, null for anything else."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin(IMAGES), F.lit(0)).when(ext.isin(VIDEOS), F.lit(1))


def passed_over(relative: Column) -> Column:
    """Whether any part of a path below the root is hidden or a recycle bin."""
    return F.exists(F.split(relative, "/"), lambda p: F.startswith(p, F.lit(".")) | F.lower(p).isin(PASSED_OVER))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime_ms, kind) of the media files below a root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    return seen(files, root)


def seen(files: DataFrame, root: str) -> DataFrame:
    below = F.substring(F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/"), len(root.rstrip("/")) + 2, 1 << 20)
    rows = files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), kind(F.col("path")).alias("kind"), below.alias("__below"))
    return rows.filter(F.col("kind").isNotNull() & ~passed_over(F.col("__below"))).drop("__below")


def packet(content: Column) -> Column:
    """The first XMP packet in the head of a file, as text."""
    text = F.decode(F.substring(content, 1, HEAD), "ISO-8859-1")
    raw = F.regexp_extract(text, r"(?s)(<x:xmpmeta.*?</x:xmpmeta>)", 1)
    return F.nullif(F.decode(F.encode(raw, "ISO-8859-1"), "UTF-8"), F.lit(""))


def _unescaped(text: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def keywords(xmp: Column) -> Column:
    """Items of the subject bag, in order; what stands before a break in the markup still counts."""
    bag = F.regexp_extract(xmp, r"(?s)<dc:subject>(.*?)(?:</dc:subject>|$)", 1)
    items = F.regexp_extract_all(bag, F.lit(r"(?s)<rdf:li[^>]*>(.*?)</rdf:li>"), F.lit(1))
    return F.filter(F.transform(items, lambda x: F.trim(_unescaped(x))), lambda x: x != "")


def description(xmp: Column) -> Column:
    """The default description, else the first, trimmed and at most 2,000 characters."""
    body = F.regexp_extract(xmp, r"(?s)<dc:description>(.*?)</dc:description>", 1)
    default = F.regexp_extract(body, r"""(?s)<rdf:li[^>]*xml:lang=["']x-default["'][^>]*>(.*?)</rdf:li>""", 1)
    first = F.regexp_extract(body, r"(?s)<rdf:li[^>]*>(.*?)</rdf:li>", 1)
    text = F.trim(_unescaped(F.when(default != "", default).otherwise(first)))
    return F.nullif(F.substring(text, 1, CAPTION_MOST), F.lit(""))


def rating(xmp: Column) -> Column:
    found = F.regexp_extract(xmp, r"""xmp:Rating(?:\s*=\s*["']|>)\s*([0-9])""", 1)
    return F.nullif(found, F.lit("")).cast("int")


def merged_text(xmp_words: Column, iptc_words: Column, xmp_caption: Column, iptc_caption: Column) -> Column:
    """Keywords of both in order, each once, case kept; the first caption that there is."""
    none = F.array().cast("array<string>")
    return F.struct(F.array_distinct(F.concat(F.coalesce(xmp_words, none), F.coalesce(iptc_words, none))).alias("keywords"), F.nullif(F.substring(F.trim(F.coalesce(xmp_caption, iptc_caption)), 1, CAPTION_MOST), F.lit("")).alias("caption"))


def page_text(html: Column) -> Column:
    """struct(title, keywords, description) of a web page's head."""
    meta = lambda n: F.regexp_extract(html, rf"""(?is)<meta\s+name=["']{n}["']\s+content=["']([^"']*)["']""", 1)
    words = F.filter(F.transform(F.split(meta("keywords"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.nullif(F.trim(_unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit("")).alias("title"), words.alias("keywords"), F.nullif(F.trim(_unescaped(meta("description"))), F.lit("")).alias("description"))


def sidecar_lines(files: DataFrame, folder: str = "folder_id", text: str = "text") -> DataFrame:
    """(folder_id, no, section, key, value) of INI texts; a line that is none of these is skipped."""
    lines = files.select(F.col(folder).alias("folder_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("no", "line"))
    head = F.regexp_extract("line", r"^\s*\[(.*)\]\s*$", 1)
    lines = lines.withColumn("__head", F.when(F.regexp_like("line", F.lit(r"^\s*\[.*\]\s*$")), F.lower(head)))
    w = Window.partitionBy("folder_id").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("section", F.last("__head", ignorenulls=True).over(w))
    pair = F.split("line", "=", 2)
    return lines.filter("__head is null and section is not null and instr(line, '=') > 0").select("folder_id", "no", "section", F.lower(F.trim(pair[0])).alias("key"), F.trim(pair[1]).alias("value"))


def sidecar_facts(lines: DataFrame) -> DataFrame:
    """Per (folder_id, file): starred, hidden, faces as (contact, rect), album tokens. A file without a line has no row."""
    own = lines.filter(~F.startswith("section", F.lit(".album:")) & ~F.col("section").isin("contacts2", "contacts", "picasa", "encoding"))
    last = lambda k: F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("no")))
    rows = own.groupBy("folder_id", F.col("section").alias("file")).agg(last("star").alias("star"), last("hidden").alias("hide"), last("faces").alias("faces"), last("albums").alias("albums"))
    yes = lambda c: F.coalesce(F.lower(F.col(c)).isin("yes", "1", "true"), F.lit(False))
    return rows.select("folder_id", "file", yes("star").alias("starred"), yes("hide").alias("hidden"), parse_faces(F.coalesce("faces", F.lit(""))).alias("faces"), F.array_remove(F.split(F.lower(F.coalesce("albums", F.lit(""))), r"\s*,\s*"), "").alias("albums"))


def parse_faces(text: Column) -> Column:
    """``rect64(..),contact;…`` as an array of (contact, rect); malformed parts and nameless contacts go."""
    each = F.transform(F.split(text, ";"), lambda p: F.struct(F.lower(F.trim(F.get(F.split(p, ","), F.lit(1)))).alias("contact"), S.rect64(F.trim(F.get(F.split(p, ","), F.lit(0)))).alias("rect")))
    return F.filter(each, lambda x: x["rect"].isNotNull() & x["contact"].isNotNull() & (x["contact"] != "") & (x["contact"] != "ffffffffffffffff"))


def export_names(files: DataFrame, name: str = "file_name", key: str = "id") -> DataFrame:
    """``out_name``: no two alike, whatever the case. By ``key``, a name that is taken gets the first free one of `` (2)``,
    `` (3)`` and so on before its extension.

    Names can only clash within a family: those that are alike without such numbers. Where all names of a family are alike
    a row's number is its place among them, which comes from one order of all rows, so that a name which every camera
    gives is many tasks. The names of other families are dealt family by family.
    """
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    rows = files.withColumn("__family", F.lower(F.concat(F.regexp_replace(stem, r"( \([0-9]+\))+$", ""), F.lit("/"), ext)))
    families = rows.groupBy("__family").agg(F.min(F.lower(name)).alias("__low"), F.max(F.lower(name)).alias("__high"))
    plain = families.filter("__low = __high").select("__family")
    placed = with_position(rows.join(plain, "__family", "left_semi"), [F.asc("__family"), F.asc(key)], "__pos", size=estimated_bytes(files))
    first = placed.groupBy(F.col("__family").alias("__f")).agg(F.min("__pos").alias("__first"))
    placed = placed.join(first, F.col("__family") == F.col("__f")).withColumn("__n", F.col("__pos") - F.col("__first") + 1)
    numbered = F.when(F.col("__n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), F.col("__n").cast("string"), F.lit(")"), ext))
    done = placed.select(*files.columns, numbered.alias("out_name"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out, last = set(), [], {}
        pdf = pdf.sort_values("__key")
        for own in pdf["__name"]:
            dot = own.rfind(".")
            head, tail = (own[:dot], own[dot:]) if dot >= 0 else (own, "")
            new, n = own, last.get(own.lower(), 1)
            while new.lower() in taken:
                n += 1
                new = f"{head} ({n}){tail}"
            last[own.lower()] = n
            taken.add(new.lower())
            out.append(new)
        return pd.DataFrame({"__k": pdf["__key"], "__out": out})

    mixed = rows.join(plain, "__family", "left_anti").filter(F.col(name).isNotNull())
    dealt = mixed.select("__family", F.col(key).alias("__key"), F.col(name).alias("__name")).groupBy("__family").applyInPandas(deal, f"__k {files.schema[key].dataType.simpleString()}, __out string")
    rest = mixed.join(dealt, F.col(key) == F.col("__k")).select(*files.columns, F.col("__out").alias("out_name"))
    return done.unionByName(rest).unionByName(files.filter(F.col(name).isNull()).withColumn("out_name", F.lit(None).cast("string")))


def export_plan(kind_: Column, ext: Column, identity: Column, width: Column, height: Column, max_edge: int | None) -> Column:
    """``copy`` unless the edit changes something or a picture other than a GIF is larger than asked for."""
    larger = F.lit(False) if max_edge is None else (kind_ == 0) & (F.lower(ext) != "gif") & (F.greatest(width, height) > max_edge)
    return F.when(~identity | larger, F.lit("render")).otherwise(F.lit("copy"))
