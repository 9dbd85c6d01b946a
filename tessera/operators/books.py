"""Books: chapters to passages of whole paragraphs or sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import slug
from tessera.operators.chunking import count_tokens, map_rows

PASSAGE_TOKENS, OVERLAP_TOKENS = 500, 50
#: Books with a fixed id: a part of the title, and the id.
KNOWN_BOOKS = (("ai engineering", "ai-engineering"), ("the pragmatic programmer", "pragmatic-programmer"), ("designing data-intensive applications", "ddia"))
_SENTENCE = re.compile("(?<=[!?.])" + r"\s+")


def is_section(paragraph: str) -> bool:
    """Short and upper case, or ending in a colon, however long."""
    return (len(paragraph) < 100 and paragraph.isupper()) or paragraph.endswith(":")


def passages_of(content: str | None, limit: int = PASSAGE_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[str, str | None, int]]:
    """(text, section, tokens) in order.

    Paragraphs are gathered up to `limit` tokens; the last one is repeated at the start of the
    next passage if it is shorter than `overlap`.  A longer paragraph is gathered by sentence,
    without repetition.  A heading counts at once, so the passage it ends carries it too.
    """
    out: list[tuple[str, str | None, int]] = []
    held: list[str] = []
    total, section = 0, None

    def flush(joiner: str = "\n\n") -> None:
        nonlocal held, total
        if held:
            text = joiner.join(held)
            out.append((text, section, count_tokens(text)))
        held, total = [], 0

    for paragraph in (p.strip() for p in (content or "").split("\n\n")):
        if not paragraph:
            continue
        if is_section(paragraph):
            section = paragraph
        n = count_tokens(paragraph)
        if n > limit:
            flush()
            for sentence in _SENTENCE.split(paragraph):
                k = count_tokens(sentence)
                if held and total + k > limit:
                    flush(" ")
                held.append(sentence)
                total += k
            flush(" ")
            continue
        if held and total + n > limit:
            last = held[-1]
            flush()
            k = count_tokens(last)
            if k < overlap:
                held, total = [last], k
        held.append(paragraph)
        total += n
    flush()
    return out


def chunk_chapters(chapters: DataFrame, limit: int = PASSAGE_TOKENS) -> DataFrame:
    """chapters (book_id, chapter_order, chapter_title, content) to passages, numbered over the whole book from 0."""

    def rows(book, order, title: str, content: str | None) -> Iterator[tuple]:
        return ((book, order, title, i, *p) for i, p in enumerate(passages_of(content, limit)))

    types = {f.name: f.dataType.simpleString() for f in chapters.schema}
    schema = f"book_id {types['book_id']}, chapter_order {types['chapter_order']}, chapter_title string, pos int, chunk_text string, section string, token_count long"
    split = chapters.select("book_id", "chapter_order", "chapter_title", "content")
    split = map_rows(split, rows, schema)
    index = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_order", "pos")) - 1
    return split.withColumn("chunk_index", index).drop("pos")


def book_id(title: Column | str, known: tuple[tuple[str, str], ...] = KNOWN_BOOKS) -> Column:
    """Slug of the title; `known` are (part of a title, id) for books with a fixed id."""
    t = F.col(title) if isinstance(title, str) else title
    out = slug(t)
    for part, fixed in reversed(known):
        out = F.when(F.lower(t).contains(part.lower()), F.lit(fixed)).otherwise(out)
    return out
