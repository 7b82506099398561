"""Files to blocks: ``binaryFile`` rows are dispatched by format and parsed in Arrow batches; a file that cannot be read
becomes an error row and does not stop the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..functions.pytext import nfc
from ..session import through
from . import markup, office, plain, tabular
from .decode import ParseError, decode, format_of

#: Versions of the stages that a processed document records; a change of what a stage gives changes its number.
VERSIONS = {"parser": 1, "normalizer": 1, "chunker": 1}
#: Formats whose places are pages.
PAGED = ("pdf",)
PARSED = (
    "path string, format string, sha256 string, title string, blocks array<struct<path: array<string>, kind: string, text: string, first: int, last: int>>, "
    "warnings array<string>, error string")


Parser = Callable[[bytes, str], tuple[str | None, list[dict], list[str]]]


def _text(data: bytes, name: str) -> tuple:
    text, fallback = decode(data)
    return None, plain.paragraphs(text), ["fallback_encoding"] * fallback


def _note(data: bytes, name: str) -> tuple:
    text, fallback = decode(data)
    text = plain.cleaned_note(text)
    return plain.note_title(text), plain.paragraphs(text), ["fallback_encoding"] * fallback


def whole_note(data: bytes, name: str) -> tuple:
    """A parser of notes of any length that keeps long paragraphs whole."""
    text, fallback = decode(data)
    text = plain.cleaned_note(text, len(text))
    return plain.note_title(text), plain.paragraphs(text, len(text)), ["fallback_encoding"] * fallback


def _markdown(data: bytes, name: str) -> tuple:
    text, fallback = decode(data)
    meta, blocks = plain.markdown(text)
    return meta.get("title"), blocks, ["fallback_encoding"] * fallback


def _csv(data: bytes, name: str) -> tuple:
    dataset, blocks = tabular.records(data, name.rpartition(".")[2])
    return None, blocks, ["fallback_encoding"] * dataset["fallback"] + {"absent": ["no_header_row"], "uncertain": ["uncertain_header"]}.get(dataset["header"], [])


def _epub(data: bytes, name: str) -> tuple:
    meta, blocks, skipped = markup.epub(data)
    return meta.get("title"), blocks, [f"skipped_unit {n}" for n in skipped]


def _docx(data: bytes, name: str) -> tuple:
    meta, blocks = office.docx(data)
    return meta.get("title"), blocks, []


def _xlsx(data: bytes, name: str) -> tuple:
    meta, blocks, hidden = office.xlsx(data)
    return meta.get("title"), blocks, [f"hidden_sheet {n}" for n in hidden]


#: The parser of each format: (title, blocks, warnings) of the bytes and name of a file.
PARSERS: dict[str, Parser] = {"text": _text, "note": _note, "markdown": _markdown, "csv": _csv, "epub": _epub, "docx": _docx, "xlsx": _xlsx}


def parse(format: str, data: bytes, name: str = "", parsers: dict[str, Parser] = PARSERS) -> tuple[str | None, list[dict], list[str]]:
    """(title, blocks, warnings) of one file."""
    if format not in parsers:
        raise ParseError("unsupported", format)
    title, blocks, warnings = parsers[format](data, name)
    return title, [{**b, "text": nfc(b["text"])} for b in blocks], warnings


def parsed(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """PARSED for rows (path, content) such as ``binaryFile`` gives; a column media_type, if there is one, decides the format first.
    *parsers* are more parsers by format, or others in place of PARSERS."""
    media = F.col("media_type") if "media_type" in files.columns else None
    t = files.select("path", format_of(F.col("path"), media).alias("format"), F.sha2("content", 256).alias("sha256"), "content")
    known = PARSERS | (parsers or {})

    def fold(rows):
        keys, out = ("path", "kind", "text", "first", "last"), []
        for r in rows:
            head = r["path"], r["format"], r["sha256"]
            try:
                title, blocks, warnings = parse(r["format"], bytes(r["content"]), r["path"], known)
                out.append((*head, title, [{k: x[k] for k in keys} for x in blocks], warnings, None))
            except ParseError as e:
                out.append((*head, None, [], [], e.kind))
            except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed job
                out.append((*head, None, [], [], f"engine: {type(e).__name__}"))
        return out

    return through(t, fold, PARSED)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return parsed(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


def normalized(parsed_files: DataFrame) -> DataFrame:
    """*parsed_files* with the texts of their blocks normalized by kind and blank blocks dropped; doing it again changes nothing."""
    return parsed_files.withColumn("blocks", F.expr(
        f"filter(transform(blocks, b -> named_struct('path', b.path, 'kind', b.kind, 'text', {T.block_text('b.kind', 'b.text')}, 'first', b.first, 'last', b.last)), b -> b.text <> '')"))


def outline(parsed_files: DataFrame) -> DataFrame:
    """Rows (path, position, level, title, first): the headings of each file in order, which a viewer lists."""
    h = parsed_files.select("path", F.posexplode(F.expr("filter(blocks, b -> b.kind = 'heading')")).alias("position", "b"))
    return h.select("path", "position", F.size("b.path").alias("level"), F.col("b.text").alias("title"), F.col("b.first").alias("first"))


def violations(parsed_files: DataFrame) -> DataFrame:
    """Blocks that no parser may give, as rows (path, n, problem): without text, in a place that ends before it begins or does not
    exist, or, when the blocks name the format of their places (place), in a place of another format. Characters count from 0
    and end behind the last one, all other places count from 1. *parsed_files* has path, format, blocks."""
    has_place = "place" in parsed_files.schema["blocks"].dataType.elementType.names
    t = parsed_files.select("path", "format", F.posexplode("blocks").alias("n", "b"))
    chars = F.col("format").isin("text", "note")
    least, empty = F.when(chars, 0).otherwise(1), chars & (F.col("b.last") <= F.col("b.first"))
    problem = F.when(F.col("b.place") != F.col("format"), "other_format") if has_place else F.when(F.lit(False), "")
    problem = problem.when(F.trim(F.coalesce("b.text", F.lit(""))) == "", "no_text")
    problem = problem.when(F.col("b.first").isNull() | F.col("b.last").isNull() | (F.col("b.first") < least) | (F.col("b.last") < F.col("b.first")) | empty, "invalid_place")
    return t.select("path", "n", problem.alias("problem")).where("problem is not null")


def processed(parsed_files: DataFrame) -> DataFrame:
    """*parsed_files* with needs_ocr, the error of files without text, blocks to chunk (none if text has to be recognised first)
    and the versions of the stages: a paged document without text needs OCR, any other is an error, empty."""
    text = F.expr("exists(blocks, b -> trim(coalesce(b.text, '')) <> '')")
    paged = F.col("format").isin(*PAGED)
    fine = F.col("error").isNull()
    t = parsed_files.withColumn("needs_ocr", fine & paged & ~text).withColumn("error", F.when(fine & ~paged & ~text, "empty").otherwise(F.col("error")))
    return t.withColumn("blocks", F.expr("if(needs_ocr or error is not null, slice(blocks, 1, 0), blocks)")).withColumn("versions", F.struct(*[F.lit(v).alias(k) for k, v in VERSIONS.items()]))
