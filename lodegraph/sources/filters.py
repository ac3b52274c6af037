"""Which files of a source tree are source code."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K


def glob_regex(pattern: str, anchored: bool = True) -> str:
    """A glob as a Java regular expression: * and ? cross slashes, [...] is a set of characters."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            j = pattern.find("]", i + 1 if pattern[i : i + 1] in "!]" else i)
            if j < 0:
                out += r"\["
            else:
                body = pattern[i:j].replace("\\", r"\\")
                out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
                i = j + 1
        else:
            out += c if c.isalnum() or c in "_/-" else "\\" + c
    return f"^{out}$" if anchored else out


def matches(path: Column, pattern: str, dirs_only: bool = False) -> Column:
    """dir/ tests every part of the path, the file name too unless dirs_only; a pattern with / tests the path, others the name."""
    if pattern.endswith("/"):
        parts = F.split(path, "/")
        parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))) if dirs_only else parts
        return F.exists(parts, lambda p: p.rlike(glob_regex(pattern[:-1])))
    return (path if "/" in pattern else C.base_name(path)).rlike(glob_regex(pattern))


@dataclass
class SourceFilter:
    """What to leave out of a source tree. gitignore: lines of a .gitignore at the root; they only take away files that are no
    source code, and build products."""

    include_tests: bool = False
    include_docs: bool = False
    custom: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=lambda: list(K.SOURCE_EXTENSIONS))
    gitignore: list[str] = field(default_factory=list)
    dirs_only: bool = False

    def patterns(self) -> list[str]:
        families = [K.DEPENDENCY_PATTERNS, K.BUILD_PATTERNS, K.SYSTEM_PATTERNS, [] if self.include_tests else K.TEST_PATTERNS, [] if self.include_docs else K.DOC_CONFIG_PATTERNS, self.custom]
        return list(dict.fromkeys(p for f in families for p in f))

    def _any(self, path: Column, patterns: list[str]) -> Column:
        """One alternation for the parts, one for the names, one for the paths."""
        parts = [glob_regex(p[:-1], False) for p in patterns if p.endswith("/")]
        names = [glob_regex(p, False) for p in patterns if "/" not in p]
        paths = [glob_regex(p, False) for p in patterns if "/" in p and not p.endswith("/")]
        alt = lambda xs: f"^(?:{'|'.join(xs)})$"
        pieces = F.split(path, "/")
        pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))) if self.dirs_only else pieces
        tests = ([F.exists(pieces, lambda p: p.rlike(alt(parts)))] if parts else []) + ([C.base_name(path).rlike(alt(names))] if names else []) + ([path.rlike(alt(paths))] if paths else [])
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    def reason(self, path: Column | str) -> Column:
        """outside, gitignore, gitignore_build_artifact, pattern, not_source_extension (kept) or include (kept)."""
        p = C.normal_path(path)
        ext = C.suffix(p)
        source = ext.isin(self.extensions)
        ignored = self._any(p, [g.strip().lstrip("/") for g in self.gitignore if g.strip() and g.strip()[0] not in "#!"])
        product = C.base_name(p).rlike(r"\.(?:pyc|pyo|pyd|class|o|obj)$|\.min\.(?:js|css)$")
        return F.when(p.startswith(".."), "outside").when(ignored & ~source, "gitignore").when(ignored & product, "gitignore_build_artifact").when(self._any(p, self.patterns()), "pattern").when((ext != "") & ~source, "not_source_extension").otherwise("include")

    def kept(self, path: Column | str) -> Column:
        return self.reason(path).isin("not_source_extension", "include")

    def summary(self) -> str:
        return f"{len(self.patterns())} patterns, tests {'in' if self.include_tests else 'ex'}cluded, docs {'in' if self.include_docs else 'ex'}cluded, {len(self.extensions)} extensions"


def source_only(extensions: list[str] | None = None) -> SourceFilter:
    return SourceFilter(extensions=extensions or list(K.SOURCE_EXTENSIONS))


def comprehensive(extensions: list[str] | None = None) -> SourceFilter:
    return SourceFilter(include_tests=True, include_docs=False, extensions=extensions or list(K.SOURCE_EXTENSIONS))


def filter_stats(files: DataFrame, rules: SourceFilter, path: str = "file_path") -> DataFrame:
    """(reason, files): how many files were kept or left out, and why."""
    return files.groupBy(rules.reason(path).alias("reason")).agg(F.count(F.lit(1)).alias("files"))
