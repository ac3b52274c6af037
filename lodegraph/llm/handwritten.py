"""Files that were not written by hand in their repository: generated, minified, vendored, or data saved as code.

First an inverted index of line hashes over all repositories: for each long enough line (numbers and spacing taken out, so that
small edits do not matter) in how many repositories it stands, which of them keep it as somebody else's (in a vendored folder
or under a package's banner), and which had it first. From it comes, exactly and without pairs of files, what share of each
file's rare lines is contained in other repositories that keep it as vendored code or had it earlier; so copies, edited ones
too, are found wherever they lie. A line is rare if it stands in at most RARE_SHARE of the repositories (or RARE_FLOOR of
them); a file without rare lines is not judged by its lines. The remaining files are judged by the composition of their tokens,
by the notices of tools and by their path.

Of several deliveries of an id any that is no hand-written file makes it a case. Null and blank contents are no case. A file
without repository is not compared with others; one without a time of creation is nobody's earlier copy. Empty tables give
empty results."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import cut
from ..tables import norm_enum, norm_id
from .common import small_batches

LEAST_LINE = 25
RARE_SHARE, RARE_FLOOR = 0.25, 8
CONTAINED = 0.6
_LINES = re.compile(r"\r\n|\n|\r")

VENDOR_DIRS = {"vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "deps", "extern", "external", "externals", "node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages", "godeps", "pods", "carthage"}
GENERATED_DIRS = {"gen", "generated", "__generated__", "generated-sources", "generated_sources", "autogen"}
_GENERATED_NAME = re.compile(r"(?:[._-](?:generated|gen|autogen)\.\w+|\.pb(?:\.gw)?\.(?:go|js|ts)|_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|ts)|\.g\.(?:java|ts|dart)|\.designer\.\w+)$", re.I)
_MINIFIED_NAME = re.compile(r"[.-](?:min|bundle|prod|packed)\.[cm]?js$", re.I)
_GENERATOR = re.compile(
    r"code generated by\b|<auto-?generated\b|@generated\b|\bautogen(?:erated)?\b.{0,60}(?:\bsource\b|\bfile\b|\bfrom\b|\bby\b)|^\W*autogenerated\b|\bmachine[- ](?:written|generated|made)\b|\bauto(?:matically)?[- ]?generated\s+(?:by|from|file|code|source|on|using|with)\b|\b(?:file|code|source) (?:is|was|has been) (?:auto(?:matically)?[- ]?)?(?:re)?generated\b|\bgenerated (?:by|from|using|with)\b.{0,80}\b(?:do not|don't|regenerate)\b|\bdo not (?:edit|modify|change)\b\W{0,3}(?:output of|this (?:generated )?file|(?:manually|by hand|directly)\b|generated\b|[-–—] ?generated)",
    re.I,
)
_BANNER = re.compile(r"\bv?\d+\.\d+(?:\.\d+)*\b.{0,20}(?:\(c\)|©|copyright).*\b(?:contributors|authors|project|upstream|foundation|licen[cs]e)|(?:\(c\)|©).{0,60}\b(?:contributors|project)\b.*\b(?:upstream|licen[cs]e)", re.I)
_SCRIPT = re.compile(r"\"(?:\\.|[^\"\\\r\n])*\"|'(?:\\.|[^'\\\r\n])*'|`(?:\\.|[^`\\])*`|//[^\r\n]*|/\*.*?\*/", re.S)
_PYTHON = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\r\n])*\"|'(?:\\.|[^'\\\r\n])*'|#[^\r\n]*", re.S)
_NUMBER = re.compile(r"\b0[xX][0-9a-fA-F_]+\b|\b\d[\d_.]*(?:[eE][+-]?\d+)?[lLfFdDn]?\b")
_STATEMENT = re.compile(r"\b(?:def|class|function|func|return|if|for|while|import|package|try|switch|throw|raise|public|private|await|yield|with)\b|=>")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_ROW = re.compile(r"^[^\s;,\t|][^;\t|]*(?:[;\t|][^;\t|]*){2,}$")


#: Words that say a file was made, then by or from what, and words that warn of changing it, in the languages of the corpus.
_MADE = re.compile(
    r"\b(?:(?:auto|machine|tool)[- ]?(?:generated|made|written|produced)|(?:re)?generated|produced|emitted|compiled|rendered|transpiled)\b.{0,40}?\b(?:by|from|using|with|via)\b"
    r"|\b(?:erzeugt|generiert|erstellt)\b.{0,40}?\b(?:von|aus|durch|mit)\b|\b(?:généré|genere|produit|créé)e?s?\b.{0,40}?\b(?:par|depuis|à partir|avec)\b"
    r"|\b(?:generad|cread|producid|gerad|criad|generat|creat|prodott)[oa]s?\b.{0,40}?\b(?:por|desde|con|de|da|dal|com|a partir)\b"
    r"|(?:сгенерирован|создан|сформирован)\w*\b.{0,40}?(?:автоматически|\bиз\b|с помощью|программой|инструментом)|автоматически\s+(?:сгенерирован|создан|сформирован)"
    r"|自動(?:的に)?生成|(?:によ(?:り|って)|から).{0,20}生成|自动生成|由.{0,30}生成",
    re.I,
)
_WARNS = re.compile(
    r"\b(?:do not|don't|never|must not be|should not be|not to be) (?:be )?(?:edit|modif|chang|touch|alter)\w*|\b(?:changes|edits|modifications)\b.{0,30}\b(?:lost|overwritten|discarded|dropped)\b|\bre-?(?:generate|run)\b|\boverwritten\b"
    r"|\bnicht (?:bearbeiten|ändern|editieren|verändern)|änderungen\b.{0,30}\b(?:verloren|überschrieben)|\bne (?:pas|jamais) (?:éditer|modifier|changer|toucher)|modifications?\b.{0,30}\b(?:perdues?|écrasées?)"
    r"|\bn(?:o|ão|on) (?:editar|edite|modificar|modifique|modificare|cambiar|alterar)|cambios\b.{0,30}\bperder|не (?:редактир|измен|меня|прав)\w*|изменения\b.{0,30}(?:потер|утра|перезапис)\w*"
    r"|(?:編集|変更|修正)(?:しない|禁止|不可)|(?:请勿|不要|勿)(?:手动)?(?:编辑|修改)",
    re.I,
)


def is_notice(notes: list[str]) -> bool:
    """Whether comment lines at a file's edge say that a tool made it: in a known form, or by saying so and warning of changes
    in the same or the next line."""
    if any(_GENERATOR.search(x) for x in notes):
        return True
    return any(_MADE.search(two) and _WARNS.search(two) for two in (" ".join(notes[n : n + 2]) for n in range(len(notes))))


def _edges(text: str, python: bool) -> list[str]:
    """The comment lines before and after all code."""
    lines = _LINES.split(text)
    out: list[str] = []
    for part, block_end in ((lines, "*/"), (lines[::-1], "/*")):
        inside = False
        for raw in part:
            x = raw.strip().lstrip("﻿").strip()
            if inside:
                out.append(x)
                inside = block_end not in x
            elif not x:
                continue
            elif python and x.startswith("#"):
                out.append(x)
            elif not python and (x.startswith("//") or x.startswith("/*") or (block_end == "/*" and x.endswith("*/"))):
                out.append(x)
                inside = (x.startswith("/*") and "*/" not in x) if block_end == "*/" else (x.endswith("*/") and "/*" not in x)
            else:
                break
    return out


def composition(text: str, python: bool) -> dict[str, float]:
    """What a file's tokens are made of."""
    strings: list[int] = []
    comments = 0

    def took(m: re.Match) -> str:
        nonlocal comments
        if m[0][0] in "#/":
            comments += len(m[0])
            return ""
        strings.append(len(m[0]))
        return "\x01"

    bare = (_PYTHON if python else _SCRIPT).sub(took, text)
    code = _NUMBER.sub("\x02", bare)
    tight = re.sub(r"\s+", "", code)
    names = _NAME.findall(code)
    rows = [x for x in _LINES.split(bare) if x.strip()]
    whole = len(re.sub(r"\s+", "", bare)) + sum(strings) - len(strings)
    solid = sum(map(len, rows)) or 1
    return {
        "size": whole,
        "names": len(names),
        "name_share": sum(map(len, names)) / max(1, whole),
        "short_names": sum(len(n) <= 2 for n in names) / max(1, len(names)),
        "statements": len(_STATEMENT.findall(code)),
        "literals": len(strings) + tight.count("\x02"),
        "long_lines": sum(len(x) for x in rows if len(x) > 200) / solid,
        "spaces": sum(x.count(" ") + x.count("\t") for x in rows) / solid,
        "lines": len(rows),
        "shapes": len({re.sub(r"\d+", "0", x.strip()) for x in rows}),
    }


def _is_rows(text: str) -> bool:
    """Whether a text is a table: most lines have as many separators as the first."""
    lines = [x for x in _LINES.split(text) if x.strip()]
    if len(lines) < 3:
        return False
    for sep in (";", "\t", "|", ","):
        n = lines[0].count(sep)
        if n >= 2 and sum(x.count(sep) >= n for x in lines) >= 0.9 * len(lines) and sum(bool(re.search(r"[(){}=]|\w" + re.escape(sep) + r"\s*$", x)) for x in lines) < 0.2 * len(lines):
            return True
    return False


def judge(path: str | None, text: str) -> tuple[str, str] | None:
    """What a file is by itself - generated, vendored, minified or data - and by which way; None if nothing says so."""
    path = (path or "").replace("\\", "/")
    parts = [x.lower() for x in path.split("/")]
    python = path.lower().endswith((".py", ".pyi", ".pyw"))
    if VENDOR_DIRS & set(parts[:-1]):
        return "vendored", "path"
    notes = _edges(text, python)
    if any(_BANNER.search(x) for x in notes[:8]):
        return "vendored", "notice"
    kind = _by_tokens(text, python)
    if kind:
        return kind, "composition"
    if is_notice(notes):
        return "generated", "notice"
    if GENERATED_DIRS & set(parts[:-1]) or _GENERATED_NAME.search(parts[-1]):
        return "generated", "path"
    if _MINIFIED_NAME.search(parts[-1]):
        return "minified", "path"
    return None


def _by_tokens(text: str, python: bool) -> str | None:
    stripped = text.lstrip("\ufeff \t\r\n")
    if (stripped[:1] in "{[" and not python and stripped[:2] != "{%" and re.match(r"[{\[]\s*(?:\"|[\d\[{]|$)", stripped)) or (python and re.match(r"[{\[]\s*\"[^\"]*\"\s*[:,]", stripped)):
        return "data"
    c = composition(text, python)
    if c["size"] >= 300 and c["statements"] and c["long_lines"] > 0.5 and c["spaces"] < 0.12 and c["short_names"] > 0.4:
        return "minified"
    if c["lines"] >= 30 and c["shapes"] < 0.1 * c["lines"] and c["statements"] >= 0.2 * c["lines"]:
        return "generated"
    if c["size"] >= 200 and c["literals"] >= 20 and c["statements"] <= 1 + 0.02 * c["literals"] and c["names"] <= 0.25 * c["literals"] + 20 and c["name_share"] < 0.3:
        return "data"
    if c["size"] >= 200 and c["statements"] <= 3 and c["name_share"] < 0.1:
        return "data"
    return "data" if _is_rows(text) else None


_FILES = pa.schema([("entity_id", pa.string()), ("delivery", pa.int64()), ("repo", pa.int64()), ("at", pa.timestamp("us", "UTC")), ("kind", pa.string()), ("way", pa.string()), ("lines", pa.list_(pa.int64()))])
_DDL = "entity_id string, delivery long, repo long, at timestamp, kind string, way string, lines array<long>"
_DIGITS, _SPACES = re.compile(r"\d+"), re.compile(r"\s+")


def _digest(x: str) -> int:
    # 63 bits of the hash: fits a bigint and stays positive
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1


def line_hashes(text: str) -> set[int]:
    """Hashes of the long enough lines, numbers and spacing taken out."""
    return {_digest(_DIGITS.sub("0", _SPACES.sub(" ", x))) for raw in _LINES.split(text) if len(x := raw.strip()) >= LEAST_LINE}


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, out = batch.column(4), []
        for n, (entity, repo, path, text) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)))):
            if not text.strip("\ufeff \t\r\n\f\v"):
                continue
            kind, way = judge(path, text) or (None, None)
            out.append((n, entity, _digest(text), None if repo is None else _digest(repo), kind, way, np.fromiter(line_hashes(text), np.int64)))
        if out:
            n, *columns = zip(*out)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, [f for f in _FILES if f.name != "at"])]
            yield pa.RecordBatch.from_arrays([*arrays[:3], at.take(pa.array(n)).cast(_FILES.field("at").type), *arrays[3:]], schema=_FILES)


def line_index(lines: DataFrame) -> DataFrame:
    """(line, rows, repos, v0, v1, first, since): for each line in more than one repository how many rows and different
    repositories have it, the least and the greatest of those that keep it as vendored, and which had it first. Rows are
    merged by line and repository first, so a line that is everywhere spreads over its repositories."""
    by_repo = lines.where("repo is not null").groupBy("line", "repo").agg(F.count(F.lit(1)).alias("rows"), F.min(F.unix_micros("at")).alias("t"), F.max("vendored").alias("v"))
    order = F.col("t") * 1024 + F.col("repo").bitwiseAND(1023)  # ties of time are decided by the repository
    theirs = F.when(F.col("v"), F.col("repo"))
    return by_repo.groupBy("line").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("repos"), F.min(theirs).alias("v0"), F.max(theirs).alias("v1"), F.min_by("repo", order).alias("first"), F.shiftright(F.min(order), 10).alias("since")).where("repos > 1")


def not_handwritten(entities: DataFrame, contained: float = CONTAINED, rare_share: float = RARE_SHARE, rare_floor: int = RARE_FLOOR) -> DataFrame:
    """(entity_id, kind, way, contained): the FILE entities not written by hand in their repository. kind: vendored, generated,
    minified or data; way: what told it - containment, composition, notice or path; contained: the share of the file's rare
    lines that other repositories keep as vendored or had earlier, where that share reaches the threshold."""
    spark = entities.sparkSession
    small_batches(spark, 500)
    rows = entities.where(norm_enum("entity_type") == "FILE").where("content is not null").select(norm_id("id").alias("entity_id"), "repository_id", "file_path", "content", "created_at")
    looked = cut(rows.where("entity_id is not null").mapInArrow(_look, _DDL))
    lines = looked.select("entity_id", "delivery", "repo", "at", F.coalesce(F.col("kind") == "vendored", F.lit(False)).alias("vendored"), F.explode("lines").alias("line"))
    index = cut(line_index(lines))
    repos = looked.agg(F.countDistinct("repo")).first()[0]
    limit = max(rare_floor, rare_share * repos)
    # the index knows the counts, so the hot lines (at most 4 x partitions of them) come without a further pass
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = looked.agg(F.sum(F.size("lines"))).first()[0] or 0
    hot = [r[0] for r in index.where(F.col("rows") > max(20_000, total / (4 * parts))).select("line").collect()]
    own = F.col("repo")
    theirs = (F.col("v0") != own) | (F.col("v1") != own) | ((F.col("first") != own) & (F.col("since") < F.unix_micros("at")))
    met = lookup_join(lines.where("repo is not null").select("entity_id", "delivery", "repo", "at", "line"), index, "line", "inner", hot)
    rare = F.col("repos") <= limit
    met = met.groupBy("entity_id", "delivery").agg(F.count_if(~rare).alias("common"), F.count_if(rare & F.coalesce(theirs, F.lit(False))).alias("k"))
    size = looked.groupBy("entity_id", "delivery").agg(F.sum(F.size("lines")).alias("n"))
    share = met.where("k > 0").join(size, ["entity_id", "delivery"]).select("entity_id", (F.col("k") / (F.col("n") - F.col("common"))).alias("contained"))
    share = share.where(F.col("contained") >= contained).groupBy("entity_id").agg(F.max("contained").alias("contained"))
    marked = looked.where("kind is not null").groupBy("entity_id").agg(F.min(F.concat_ws("/", "kind", "way")).alias("x"))
    by_lines = F.col("contained").isNotNull()
    kind = F.when(by_lines, F.lit("vendored")).otherwise(F.substring_index("x", "/", 1))
    return marked.join(share, "entity_id", "full").select("entity_id", kind.alias("kind"), F.when(by_lines, F.lit("containment")).otherwise(F.substring_index("x", "/", -1)).alias("way"), F.round("contained", 6).alias("contained"))
