"""Text corpus: normalising, splitting at headers and by size, chunk keys, replacing documents.

Splitting happens inside the row with array functions, so a corpus is chunked
without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.functions.expr import uuid5

HEADER = r"\A[ \t]*(#{1,3})(?: ([^\n]*))?(?=\n|\z)"
# a fenced block as a whole, or the place before a header line
FENCE_OR_HEADER = r"(?ms)(^[ \t]*```[^`\n]*$.*?(?:^[ \t]*```|\z)|^[ \t]*~~~.*?(?:^[ \t]*~~~|\z))|(?=^[ \t]*#{1,3}(?: |$))"
CUT = "\ufdd0"
LINE_ENDS = r"\r|[\x0b\x0c\x1c-\x1e\x85  ]"
PATH_SEPARATOR = " > "


def normalised(text: Column) -> Column:
    """CRLF to LF, at most one empty line in a row, no trailing blanks, trimmed — in that order."""
    text = F.regexp_replace(text, "\r\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, LINE_ENDS, "\n")
    text = F.regexp_replace(text, r"(?U)[\s\x1f&&[^\n]]++(?=\n|\z)", "")
    return F.regexp_replace(text, r"(?U)\A[\s\x1f]+|[\s\x1f]+\z", "")


def normalise_documents(documents: DataFrame, content: str = "content") -> DataFrame:
    return documents.withColumn(content, normalised(F.col(content)))


def sections(documents: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``sections``: an array of ``(path, text)`` per document.

    A header of level one to three opens a section and stays in it; the path
    holds the headers it stands under. A header directly after a higher one
    joins its section. Fenced code is not searched for headers.
    """
    pieces = F.split(F.regexp_replace(F.col(content), FENCE_OR_HEADER, "$1" + CUT), CUT)
    empty = F.array().cast(
        "array<struct<h1:string,h2:string,h3:string,text:string,bare:int>>"
    )
    found = F.aggregate(pieces, empty, _take_piece)
    return documents.withColumn("sections", F.transform(found, lambda s: F.struct(
        F.concat_ws(PATH_SEPARATOR, s["h1"], s["h2"], s["h3"]).alias("path"),
        F.regexp_replace(s["text"], r"\A\s+|\s+\z", "").alias("text"),
    )))


def _take_piece(done: Column, piece: Column) -> Column:
    """Fold step: a piece opens a section, or continues the last one."""
    level = F.length(F.regexp_extract(piece, HEADER, 1))
    title = F.trim(F.regexp_extract(piece, HEADER, 2))
    last = F.get(done, F.size(done) - 1)
    bare = F.when(F.instr(F.trim(F.regexp_replace(piece, r"\s+\z", "")), "\n") == 0, level).otherwise(F.lit(0))

    def section(h1: Column, h2: Column, h3: Column, text: Column, only_header: Column) -> Column:
        return F.array(F.struct(
            h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), text.alias("text"), only_header.cast("int").alias("bare")
        ))

    none = F.lit(None).cast("string")
    headed = [
        F.when(level == 1, title).otherwise(last["h1"]),
        F.when(level == 2, title).when(level > 2, last["h2"]).otherwise(none),
        F.when(level == 3, title).otherwise(none),
    ]
    before = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    continued = section(last["h1"], last["h2"], last["h3"], F.concat(last["text"], piece),
                        F.when(F.trim(F.translate(piece, "\n", "")) == "", last["bare"]).otherwise(F.lit(0)))
    joined = section(*headed, F.concat(last["text"], piece), bare)
    return (
        F.when((F.size(done) == 0) & (F.trim(F.translate(piece, "\n", "")) == ""), done)
        .when((level == 0) & (F.size(done) == 0), section(none, none, none, piece, F.lit(0)))
        .when(level == 0, F.concat(before, continued))
        .when((last["bare"] > 0) & (last["bare"] < level), F.concat(before, joined))
        .otherwise(F.concat(done, section(*headed, piece, bare)))
    )


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def size_parts(section: Column, chunk_size: int, chunk_overlap: int) -> Column:
    """Parts of a section with its words: the text itself if short enough, else windows of words with overlap."""
    tokens = section["words"]
    step = chunk_size - chunk_overlap
    last = F.greatest(F.size(tokens) - chunk_overlap - 1, F.lit(0))
    windows = F.transform(
        F.sequence(F.lit(0), last, F.lit(step)),
        lambda s: F.array_join(F.slice(tokens, s + 1, chunk_size), " "),
    )
    return F.when(F.size(tokens) > chunk_size, windows).otherwise(F.array(section["text"]))


def chunk(
    documents: DataFrame, chunk_size: int = 500, chunk_overlap: int = 0, document_id: str = "document_id",
    name: str = "name", content: str = "content", source: str = "source",
) -> DataFrame:
    """``(chunk_id, document_id, document_name, content, source, point_id)``, numbered over the whole document."""
    if not 0 <= chunk_overlap < chunk_size:
        raise ValueError("chunk_overlap must be at least 0 and below chunk_size")
    counted = F.transform(
        "sections", lambda s: F.struct(s["path"].alias("path"), s["text"].alias("text"), words(s["text"]).alias("words"))
    )
    parts = F.flatten(
        F.transform(
            counted,
            lambda s: F.transform(
                F.filter(size_parts(s, chunk_size, chunk_overlap), lambda p: F.trim(p) != ""),
                lambda p: F.when(s["path"] != "", F.concat(s["path"], F.lit("\n"), p)).otherwise(p),
            ),
        )
    )
    split_up = sections(documents.filter(F.length(content) > 0), content)
    numbered = split_up.select(
        F.col(document_id).cast("string").alias("document_id"), F.col(name).cast("string").alias("document_name"),
        F.col(source).alias("source"), F.posexplode(parts).alias("number", "content"),
    )
    return numbered.select(
        F.concat_ws(":", "document_id", F.col("number").cast("string")).alias("chunk_id"),
        "document_id", "document_name", "content", "source",
    ).withColumn("point_id", uuid5(F.col("chunk_id")))


def replace_documents(chunks: DataFrame, incoming: DataFrame) -> DataFrame:
    """All chunks of the incoming documents are replaced; other documents stay."""
    documents = incoming.select("document_id").distinct()
    return chunks.join(documents, "document_id", "left_anti").unionByName(incoming)
