"""Functions paired with their documentation.

The documentation of a function is its docstring column, the documentation string or leading comment within its content, or the
comment that ends on the line directly above it in its file. All of these are entered into a symbol table over all files
(repository, qualified name, signature normalised by language, so that overloads stay apart), and definitions are joined with
what is written at declarations of theirs that have no body. Only then is filtered: of a function's documentation, its own
first, the first counts that says something, that has, after everything formal is taken away (see description), at least
LEAST_WORDS different words that are not words of the name. Of several declarations of a symbol the one that says something
counts, then the first by path and line.

Comments above functions are found in the files as a table of comment ends and joined by file and line, so no file is
co-located with its functions and a file with very many functions is no hot group. Functions whose documentation is null, empty
or trivial are dropped, as are rows without id. Of repeated deliveries the latest counts. Null paths or lines match no comment.
Empty tables give empty results."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import norm_enum, norm_id
from .common import extension, file_rows, latest, small_batches

#: Different words that a documentation must have besides the function's own name.
LEAST_WORDS = 5

_LINES = re.compile(r"\r\n|\n|\r")
_MARKS = re.compile(r"^\s*(?:[rRuUbB]{0,2}(?:\"\"\"|''')|/\*+!?|\*+/|\*(?!/)|//+!?|#+!?)?\s?")
_TAIL = re.compile(r"\s*(?:\*+/|\"\"\"|''')\s*$")
_TAG = re.compile(r"^\s*(?:[@\\](?:param|arg|argument|tparam|returns?|throws?|raises?|exception|type|typedef|property|prop|template|yields?|see|since|author|version|deprecated|override|internal|public|private|protected|readonly)\b|:(?:param|parameter|arg|argument|key|keyword|type|raises?|raise|except|exception|returns?|rtype|var|ivar|vartype|yields?|meta)\b[^:]*:)")
_SECTION = re.compile(r"^\s*(?:args?|arguments|params?|parameters|other parameters|keyword args|keyword arguments|returns?|yields?|raises?|throws|exceptions?|errors|attributes|warns)\s*:\s*$", re.I)
_NUMPY = re.compile(r"^\s*(?:parameters|other parameters|returns?|yields?|raises?|warns|attributes|receives)\s*$", re.I)
_RULE = re.compile(r"^\s*(?:[-=~*_#+.]\s*){3,}$")
_TOOL = re.compile(
    r"^\s*(?:#\s*)?(?:eslint\b|jshint\b|jslint\b|tslint\b|prettier-ignore|stylelint-|biome-ignore|deno-(?:lint|fmt)-ignore|(?:istanbul|c8|v8|codecov|coverage)[: ]ignore|webpack\w+:|noqa\b|nolint\b|nosec\b|nosonar\b|(?:pylint|pyright|mypy|ruff|flake8|isort|black|yapf|checkstyle|sonar|cspell|lint|language|rubocop|detekt|swiftlint|golangci(?:-lint)?|semgrep|skipcq|lgtm)\s*[:=\[]|fmt:\s*(?:on|off|skip)|type:\s*ignore|pragma\b|(?:en)?coding\s*[:=]|-\*-|vim?:|@?suppress\w*\s*\(|clang-format\s+o|go:\w|\+build\b|line\s+\d|#?(?:end)?region\b|@(?:ts-\w+|formatter|jsx|flow|preserve|generated)|<reference\b|noinspection\b|ktlint-).*$",
    re.I,
)
_LICENCE = re.compile(r"^\s*(?:SPDX-|copyright\b|\(c\)|©|licen[cs]ed?\b|all rights reserved|@licen[cs]e).*$", re.I)
_MISSING = re.compile(
    r"^\W*(?:todo|fixme|xxx|tbd|tba|tbc|wip|hack|n/?a|none|null|nil|undefined|undocumented|no (?:docs?|documentation|description|comment)s?\b|not (?:yet )?documented|missing (?:docs?|documentation|description)|(?:docs?|documentation|description|comment)s? (?:is |are )?(?:missing|pending|to (?:come|follow|do)|goes here|tbd)|(?:add|write|insert|fill in|describe)\b.{0,40}\b(?:docs?|documentation|description|comment|later|here|this)\b|\{?@?inherit(?:s|ed)?\s*-?_?doc\b|inherited\b|see (?:above|below|base|super|parent|the (?:base|super|parent|interface)|interface|overrid)|same as (?:above|below|base)|auto-?generated|placeholder|lorem ipsum|non-javadoc|default (?:constructor|implementation)|to be (?:done|documented|written|defined)|coming soon|work in progress|describe me|fill me)\b.*$",
    re.I,
)
_CODE = [
    re.compile(p)
    for p in (
        r"^\s*(?:.*[=()\[\]].*[;{]|[{}()\[\];,]+)\s*$",
        r"^\s*(?:[\w.$]+(?:\[[^\]]*\])*\s*(?:,\s*[\w.$]+\s*)*)(?::\s*[\w\[\]<>.]+\s*)?(?:=|\+=|-=|\*=|/=|:=|\|=)\s*\S.*$",
        r"^\s*(?:await\s+|return\s+|yield\s+|new\s+|defer\s+|go\s+|del\s+|assert\s+|raise\s+|throw\s+)?[\w.$]+\([^()]*(?:\([^()]*\)[^()]*)*\)(?:\.\w+\([^()]*\))*\s*$",
        r"^\s*(?:if|elif|for|while|with|def|class|try|except|else|finally|switch|case|match)\b[^.!?]*:\s*$",
        r"^\s*(?:return|yield|raise|throw|break|continue|pass)\b\s*[\w.$()\[\]'\"]*\s*$",
        r"^\s*(?:import\s+[\w.{*\"']|from\s+[\w.]+\s+import\b|const\s+\w+\s*=|let\s+\w+\s*=|var\s+\w+\s*[=\w]|package\s+[\w.]+\s*$)",
    )
]
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_HUMPS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")


def name_words(name: str | None) -> set[str]:
    """The words of an identifier: its parts between underscores and at changes of case, and itself."""
    if not name:
        return set()
    return {w.lower() for w in _HUMPS.findall(name)} | {w.lower() for w in _WORD.findall(name)} | {name.lower()}


def description(doc: str | None) -> str:
    """What a documentation says: without comment marks, entries for parameters, results and errors, notices to tools, licence
    tags, commented-out code, and notes that the text is missing, still to come or inherited."""
    if not doc or not doc.strip():
        return ""
    out: list[str] = []
    section: int | None = None  # indentation of the header whose entries are skipped
    numpy = tag = False
    lines = [_TAIL.sub("", x) for x in _LINES.split(doc)]
    bare = []
    for raw in lines:
        m = _MARKS.match(raw)
        bare.append((len(raw) - len(raw.lstrip()) if not raw[: m.end()].strip() else m.end() + len(raw[m.end() :]) - len(raw[m.end() :].lstrip()), raw[m.end() :] if raw[: m.end()].strip() else raw))
    for n, (indent, text) in enumerate(bare):
        body = text.strip()
        if not body or _RULE.match(body):
            tag = False
            if not body:
                numpy = False
                if section is not None and not any(b.strip() and i > section for i, b in bare[n + 1 : n + 2]):
                    section = None
            if out and out[-1]:
                out.append("")
            continue
        if _NUMPY.match(body) and n + 1 < len(bare) and _RULE.match(bare[n + 1][1].strip() or "x"):
            numpy, section, tag = True, None, False
            continue
        if numpy:
            continue
        if _SECTION.match(body):
            section, tag = indent, False
            continue
        if section is not None:
            if indent > section:
                continue
            section = None
        if _TAG.match(body):
            tag = True
            continue
        if tag and indent > 1 and text[:2].isspace():
            continue
        tag = False
        if _TOOL.match(body) or _LICENCE.match(body) or _MISSING.match(body):
            continue
        if any(p.match(body) for p in _CODE):
            continue
        out.append(body)
    return "\n".join(out).strip()


def telling_words(doc: str | None, name: str | None) -> int:
    """How many different words the description has that are not words of the name. A sign of a script without spaces
    between words counts as a word."""
    text = description(doc)
    if not text:
        return 0
    own = name_words(name)
    words = {w.lower() for w in _WORD.findall(_CJK.sub(" ", text))} - own
    return len(words) + len(set(_CJK.findall(text)))


def _literal(text: str) -> str | None:
    """The string literal that text begins with."""
    m = re.match(r"[rRuUbB]{0,2}(\"\"\"|''')", text)
    if m:
        end = text.find(m[1], m.end())
        return text[m.end() : end] if end >= 0 else None
    m = re.match(r"[rRuU]?(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)')\s*(?:\n|\r|$|;|#)", text)
    return (m[1] if m[1] is not None else m[2]) if m else None


_DEF = re.compile(r"(?:\s*@[^\r\n]*[\r\n]+)*\s*(?:async\s+)?def\s+\w+\s*(?:\[[^\]]*\])?\s*\(")
_AFTER = re.compile(r"\s*(?:->[^:\r\n]+(?:\[[^\]\r\n]*\])?)?\s*:[^\S\r\n]*(?:#[^\r\n]*)?\s*")


def python_docstring(content: str) -> str | None:
    """The documentation string of a function's source."""
    m = _DEF.search(content)
    if not m:
        return None
    depth, at = 1, m.end()
    for x in re.finditer(r"[()]|\"[^\"\n]*\"|'[^'\n]*'|#[^\n]*", content[at:]):
        depth += {"(": 1, ")": -1}.get(x[0], 0)
        if not depth:
            after = _AFTER.match(content, at + x.end())
            return _literal(content[after.end() :]) if after else None
    return None


_PYTHON = {"py", "pyi", "pyw"}


def _comment_start(line: str, python: bool) -> str:
    text = line.lstrip()
    if python:
        return "#" if text.startswith("#") else ""
    return "//" if text.startswith("//") else "/*" if text.startswith("/*") else ""


def leading_comment(content: str, python: bool) -> str | None:
    """The comment with which a function's source begins."""
    out: list[str] = []
    inside = False
    for line in _LINES.split(content):
        if inside:
            out.append(line)
            inside = "*/" not in line
            continue
        kind = _comment_start(line, python)
        if kind:
            out.append(line)
            inside = kind == "/*" and "*/" not in line
        elif line.strip() and not (out == [] and line.lstrip().startswith("@")):
            break
    return "\n".join(out) if out else None


def comment_ends(content: str, python: bool) -> Iterator[tuple[int, str]]:
    """(line after the comment, its text) for each comment that stands on lines of its own and is followed by a line that is
    not blank. A block comment is one comment, line comments without a line between them are one."""
    run: list[str] = []
    inside = False
    lines = _LINES.split(content)
    for n, line in enumerate(lines):
        if inside:
            run.append(line)
            if "*/" not in line:
                continue
            inside = False
            if line.split("*/", 1)[1].strip():
                run = []
                continue
        else:
            kind = _comment_start(line, python)
            if not kind:
                run = []
                continue
            if kind == "/*":
                run = [line]
                if "*/" not in line:
                    inside = True
                    continue
                if line.split("*/", 1)[1].strip():
                    run = []
                    continue
            elif run and run[-1].rstrip().endswith("*/") and not python:
                run = [line]
            else:
                run.append(line)
        follower = lines[n + 1] if n + 1 < len(lines) else ""
        if follower.strip() and not _comment_start(follower, python):
            yield n + 2, "\n".join(run)


def words_of(text: str) -> list[str]:
    return sorted({w.lower() for w in _WORD.findall(_CJK.sub(" ", text))} | set(_CJK.findall(text)))


_OPEN, _CLOSE = "([{<", ")]}>"


def _parameters(signature: str, at: int) -> tuple[list[str], int]:
    """The parameters in the brackets that open at ``at``, and the place behind these."""
    depth, parts, start = 0, [], at + 1
    for i in range(at, len(signature)):
        c = signature[i]
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE and not (c == ">" and signature[i - 1] in "-="):
            depth -= 1
        if (c == "," and depth == 1) or depth == 0:
            parts.append(signature[start:i])
            start = i + 1
        if depth == 0:
            return parts, i + 1
    return [*parts, signature[start:]], len(signature)


def _type(parameter: str, language: str) -> str:
    """A parameter's type without white space; _ where none is given."""
    text = parameter.strip()
    if language == "java":
        text = re.sub(r"@\w+(?:\([^)]*\))?\s*|\bfinal\s+", "", text)
        m = re.match(r"(.+?)\s*\b[\w$]+\s*((?:\[\])*)$", text, re.S)
        kind = m[1] + m[2] if m else text
    else:
        name, colon, kind = text.partition(":")
        stars = re.match(r"\*{0,2}", text)[0] if language == "python" else "..." if text.startswith("...") else ""
        kind = stars + (re.split(r"=(?!>)", kind)[0].strip() if colon and "=" not in name else "") or "_"
    return re.sub(r"\s+", "", kind)


def normal_signature(signature: str | None, ext: str | None = None) -> str:
    """A signature without names, defaults and white space: its parameters' types by the rules of the language that the
    extension stands for (in Go the last word, and names that share a type; in Java the first words; else what follows a
    colon), or _ where there are none."""
    language = {"go": "go", "java": "java", "py": "python", "pyi": "python", "pyw": "python"}.get(ext or "", "script")
    text = signature or ""
    at = text.find("(")
    if language == "go" and at >= 0 and re.match(r"\s*func\s*\($", text[: at + 1]):
        at = text.find("(", _parameters(text, at)[1])  # the first brackets are the receiver's
    if at < 0:
        return ""
    parts = [p for p in _parameters(text, at)[0] if p.strip()]
    if language == "go":
        words = [p.split(None, 1) for p in parts]
        if any(len(w) == 2 for w in words):  # names are given: one without a type has that of the next with one
            kinds, later = [], "_"
            for w in reversed(words):
                later = re.sub(r"\s+", "", w[1]) if len(w) == 2 else later
                kinds.append(later)
            return f"({','.join(reversed(kinds))})"
        return f"({','.join(w[0] for w in words)})"
    if parts and re.fullmatch(r"\s*(?:self|cls|this)\b\s*(?::.*)?", parts[0], re.S):
        parts = parts[1:]
    return f"({','.join(_type(p, language) for p in parts if p.strip() not in ('*', '/'))})"


_DOCS = pa.list_(pa.struct([("source", pa.string()), ("words", pa.int32()), ("description", pa.string())]))
_OWN = pa.schema([("docs", _DOCS), ("name_words", pa.list_(pa.string())), ("shape", pa.string()), ("has_body", pa.bool_())])
_OWN_DDL = "docs array<struct<source:string,words:int,description:string>>, name_words array<string>, shape string, has_body boolean"


def _own_docs(texts: bool):
    """Adds to rows that end in (name, docstring, content, ext, signature) what they say of themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, columns, contents, exts, signatures = (batch.column(i).to_pylist() for i in range(batch.num_columns - 5, batch.num_columns))
            out = []
            for name, column, content, ext, signature in zip(names, columns, contents, exts, signatures):
                own, python, content = name_words(name), ext in _PYTHON, content or ""
                said = []
                for source, doc in (("docstring", column), ("content", python_docstring(content) if python else None), ("content", leading_comment(content, python))):
                    text = description(doc)
                    if text:
                        said.append({"source": source, "words": len(set(words_of(text)) - own), "description": text if texts else None})
                body = "{" in content or (python and bool(content) and not re.search(r":\s*(?:\.\.\.|pass)\s*$", content))
                out.append((said, sorted(own), normal_signature(signature, ext), body))
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*out), _OWN)] if out else [pa.array([], f.type) for f in _OWN]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *arrays], names=[*batch.schema.names[:-4], *_OWN.names])

    return run


def _comments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("repository_id", pa.string()), ("file_path", pa.string()), ("start_line", pa.int32()), ("above", pa.string()), ("above_words", pa.list_(pa.string()))])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            for line, text in comment_ends(r["content"], r["ext"] in _PYTHON):
                said = description(text)
                words = words_of(said)
                if len(words) >= LEAST_WORDS:
                    out.append((r["repository_id"], r["file_path"], line, said, words))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def documented_functions(entities: DataFrame, texts: bool = True) -> DataFrame:
    """(entity_id, name, qualified_name, repository_id, file_path, source[, description, code]) of the functions and methods
    with a documentation that says something. source: docstring, content, above or declaration. Without texts the code and the
    descriptions are left out, of the result and of the shuffles. Null repositories or names match no declaration."""
    small_batches(entities.sparkSession, 500)
    kind = norm_enum("entity_type")
    rows = entities.where(kind.isin("FUNCTION", "METHOD")).select(
        norm_id("id").alias("entity_id"), "repository_id", "file_path", F.col("start_line").cast("int").alias("start_line"), F.col("updated_at").alias("at"), "qualified_name",
        *([F.col("content").alias("code")] if texts else []), "name", "docstring", "content", extension("file_path").alias("ext"), "signature",
    ).where("entity_id is not null")
    kept = ["entity_id", "repository_id", "file_path", "start_line", "at", "qualified_name", *(["code"] if texts else []), "name"]
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in kept)
    own = rows.mapInArrow(_own_docs(texts), f"{fields}, {_OWN_DDL}")
    files = file_rows(entities).where("content is not null").select("repository_id", "file_path", "content", extension("file_path").alias("ext"))
    notes = files.mapInArrow(_comments, "repository_id string, file_path string, start_line int, above string, above_words array<string>")
    notes = notes.groupBy("repository_id", "file_path", "start_line").agg(F.max(F.struct("above", "above_words")).alias("note")).select("repository_id", "file_path", "start_line", "note.*")
    both = own.join(notes, ["repository_id", "file_path", "start_line"], "left")
    above = F.struct(F.lit("above").alias("source"), F.size(F.array_except("above_words", "name_words")).alias("words"), (F.col("above") if texts else F.lit(None).cast("string")).alias("description"))
    both = both.withColumn("docs", F.when(F.col("above_words").isNotNull(), F.concat("docs", F.array(above))).otherwise(F.col("docs")))
    symbols = latest(both, ["entity_id"], ["at"], ["repository_id", "file_path", "start_line", "qualified_name", "name", "docs", "shape", "has_body", *(["code"] if texts else [])])
    # rows that name no symbol get a key of their own, so they are no hot group
    symbol = F.concat("repository_id", F.lit("\x1f"), F.coalesce("qualified_name", "name"), F.lit("\x1f"), "shape")
    symbols = symbols.withColumn("symbol", F.coalesce(symbol, F.concat(F.lit("\x1e"), "entity_id")))
    declared = symbols.where(~F.col("has_body")).select("symbol", "file_path", "start_line", F.posexplode("docs").alias("n", "doc"))
    best = F.min(F.struct((F.col("doc.words") < LEAST_WORDS).alias("trivial"), "file_path", "start_line", "n", F.col("doc.words").alias("words"), F.col("doc.description").alias("description"))).alias("d")
    declared = declared.groupBy("symbol").agg(best)
    joined = symbols.join(declared, "symbol", "left")
    theirs = F.array(F.struct(F.lit("declaration").alias("source"), F.col("d.words").alias("words"), F.col("d.description").alias("description")))
    docs = F.when(F.col("has_body") & F.col("d").isNotNull(), F.concat("docs", theirs)).otherwise(F.col("docs"))
    said = joined.withColumn("doc", F.try_element_at(F.filter(docs, lambda x: x["words"] >= LEAST_WORDS), F.lit(1))).where("doc is not null")
    return said.select("entity_id", "name", "qualified_name", "repository_id", "file_path", F.col("doc.source").alias("source"), *([F.col("doc.description").alias("description"), "code"] if texts else []))
