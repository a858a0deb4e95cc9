"""Prompt assembly and citations over retrieved chunks, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def context_block(chunks: Column) -> Column:
    """`Source [i]: title`, a line feed and the snippet for each of array<struct<title, snippet>>, joined by blank lines."""
    one = lambda c, i: F.concat(F.lit("Source ["), (i + 1).cast("string"), F.lit("]: "), c["title"], F.lit("\n"), c["snippet"])
    return F.array_join(F.transform(chunks, one), "\n\n")


def user_turn(context: Column, response_format: Column, question: Column) -> Column:
    return F.concat(context, F.lit("\n\n"), response_format, F.lit("\n\nQuestion: "), question)


def citation_markers(answer: Column, n_chunks: Column) -> Column:
    """Distinct markers [n] of an answer with 1 <= n <= n_chunks, ascending; quoted `Source [n]:` labels do not count."""
    plain = F.regexp_replace(answer, r"Source \[\d+\]:", "Source:")
    found = F.transform(F.regexp_extract_all(plain, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= n_chunks))))


def user_turn_text(chunks: list[tuple[str, str]], response_format: str, question: str) -> str:
    """user_turn over context_block for one answer on the driver: (title, snippet) of each chunk."""
    context = "\n\n".join(f"Source [{i}]: {title}\n{snippet}" for i, (title, snippet) in enumerate(chunks, 1))
    return f"{context}\n\n{response_format}\n\nQuestion: {question}"


def markers_in(answer: str, n_chunks: int) -> list[int]:
    """citation_markers of one answer on the driver."""
    plain = re.sub(r"Source \[[0-9]+\]:", "Source:", answer)
    return sorted({int(m) for m in re.findall(r"\[([0-9]+)\]", plain) if 1 <= int(m) <= n_chunks})


def text_field(metadata: Column, name: str) -> Column:
    """A top-level field of a JSON text if it is a string, else null."""
    value = F.try_parse_json(metadata)
    is_text = F.schema_of_variant(F.variant_get(value, f"$.{name}", "variant")) == "STRING"
    return F.when(is_text, F.try_variant_get(value, f"$.{name}", "string"))


def citation_url(metadata: Column) -> Column:
    """metadata.source_url of a JSON text if it is a string, else an empty one."""
    return F.coalesce(text_field(metadata, "source_url"), F.lit(""))


def contexts(results: DataFrame) -> DataFrame:
    """query_id, chunks (array of struct, in order of position) from search results."""
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "external_id", "title", "snippet", "score"))).alias("chunks"))
    return rows


def retrieved(results: DataFrame) -> DataFrame:
    """query_id, external_id, score (the best of the document), first (place of its first chunk)."""
    return results.groupBy("query_id", "external_id").agg(F.max("score").alias("score"), F.min("position").alias("first"))


def echo_answer(last_user: Column, markers: int = 0) -> Column:
    """The test model: repeats the last user message, with markers [1] .. [n] if asked."""
    return F.concat(F.lit("[test] "), last_user, F.lit("".join(f" [{i + 1}]" for i in range(markers))))
