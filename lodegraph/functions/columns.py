"""Scalar functions on columns: text, scores, keys and checks. All stay inside the JVM.

Nulls: unless stated otherwise a null input gives a null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


# similarity and scores


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays in double; null, empty, of unequal length or all zero: 0.0."""
    a, b = _c(a), _c(b)
    d = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + d(x) * d(x)))
    both = norm(a) * norm(b)
    return F.when(F.size(a).isNull() | F.size(b).isNull() | (F.size(a) != F.size(b)) | (F.size(a) == 0), 0.0).when(both == 0, 0.0).otherwise(F.coalesce(dot / both, F.lit(0.0)))


def entity_similarity(a: Column | str, b: Column | str) -> Column:
    """As cosine, but null where a side is missing or the lengths differ."""
    a, b = _c(a), _c(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), cosine(a, b))


def is_similar(a: Column | str, b: Column | str, text_a: Column | str, text_b: Column | str, threshold: float = 0.85) -> Column:
    """Two queries are alike: by vectors where both have one, else by equal texts without case and outer white space."""
    by_text = F.lower(F.trim(_c(text_a))) == F.lower(F.trim(_c(text_b)))
    return F.coalesce(entity_similarity(a, b) >= threshold, by_text)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def distance_score(d: Column | str) -> Column:
    """1.0 at distance 0, else 1 - distance/10, between 0.02 and 1 and never below 0.01."""
    d = _c(d)
    return F.when(d == 0, 1.0).otherwise(F.greatest(F.lit(0.01), 1 - F.least(F.lit(0.98), d / 10)))


def normalized_score(cos: Column | str) -> Column:
    return (1 + _c(cos)) / 2


def highly_relevant(score: Column | str, threshold: float = 0.7) -> Column:
    return _c(score) >= threshold


def relevance(cos: Column | str) -> Column:
    """A cosine as relevance: between 0 and 1, 0.5 where there is no vector."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(cos))), F.lit(0.5))


def type_weight(kind: Column | str, weights: dict[str, float]) -> Column:
    return F.coalesce(F.element_at(_map(weights), _c(kind)), F.lit(K.OTHER_WEIGHT))


def hop_score(rel: Column, kind: Column | str, hop: Column | int) -> Column:
    return rel * type_weight(kind, K.HOP_WEIGHTS) * F.pow(F.lit(K.HOP_DECAY), F.lit(hop) if isinstance(hop, int) else hop)


def graph_score(base: Column | str, strength: Column | str, kind: Column | str) -> Column:
    return _c(base) * _c(strength) * type_weight(kind, K.GRAPH_WEIGHTS) * K.GRAPH_DAMPING


def type_bonus(kind: Column | str, text: str) -> Column:
    """0.1 for the entity types a query's text asks for: functions, else classes, else variables."""
    low = text.lower()
    if "function" in low or "method" in low:
        wanted = ["FUNCTION", "METHOD"]
    elif "class" in low:
        wanted = ["CLASS"]
    elif "variable" in low:
        wanted = ["VARIABLE", "CONSTANT"]
    else:
        return F.lit(0.0)
    return F.when(_c(kind).isin(wanted), 0.1).otherwise(0.0)


def composite_score(strength: Column | str, confidence: Column | str, frequency: Column | str) -> Column:
    return _c(strength) * _c(confidence) + F.least(_c(frequency) / 10.0, F.lit(1.0)) * 0.1


def relationship_class(kind: Column | str) -> Column:
    """Array of the classes a relationship type belongs to."""
    k = _c(kind)
    each = [F.when(k.isin(v), F.lit(n)) for n, v in (("structural", K.STRUCTURAL), ("behavioral", K.BEHAVIORAL), ("dependency", K.DEPENDENCY))]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def reverse_type(kind: Column | str) -> Column:
    return F.element_at(_map(K.REVERSE_TYPE), _c(kind))


def relationship_text(kind: Column | str, conditional: Column | bool = False, direct: Column | bool = True) -> Column:
    text = F.coalesce(F.element_at(_map(K.DESCRIPTIONS), _c(kind)), F.lower(_c(kind)))
    lit = lambda x: F.lit(x) if isinstance(x, bool) else x
    return F.concat(F.when(lit(direct), "").otherwise("indirectly "), F.when(lit(conditional), "conditionally ").otherwise(""), text)


# aggregated scores of a graph


def density(entities: Column | str, relationships: Column | str) -> Column:
    n, r = _c(entities), _c(relationships)
    return F.when(n <= 1, 0.0).otherwise(F.least(F.lit(1.0), 2.0 * r / (n * (n - 1))))


def average_degree(entities: Column | str, relationships: Column | str) -> Column:
    return F.when(_c(entities) > 0, 2.0 * _c(relationships) / _c(entities)).otherwise(0.0)


def coverage(files: Column | str, total: Column | str) -> Column:
    return F.when(_c(total) > 0, F.least(F.lit(100.0), _c(files) / _c(total) * 100)).otherwise(0.0)


def complexity(entities: Column | str, depth: Column | str, dens: Column) -> Column:
    return 0.4 * F.least(F.lit(1.0), _c(entities) / 10000.0) + 0.3 * F.least(F.lit(1.0), _c(depth) / 20.0) + 0.3 * dens


def health(completeness: Column | str, consistency: Column | str, errors: Column | str, files: Column | str) -> Column:
    return 0.4 * _c(completeness) + 0.4 * _c(consistency) + 0.2 * F.greatest(F.lit(0.0), 1 - _c(errors) / F.greatest(F.lit(1), _c(files)))


def well_connected(entities: Column | str, largest: Column | str) -> Column:
    return (_c(entities) == 0) | (_c(largest) / _c(entities) > 0.8)


# text


def snippet(content: Column | str, most: int = 200) -> Column:
    """Whole first lines of together at most ``most`` characters (line breaks not counted), and ... if that is not all."""
    c = F.coalesce(_c(content), F.lit(""))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(0).alias("lines"), F.lit(True).alias("open"))
    step = lambda s, x: F.when(s["open"] & (s["n"] + F.char_length(x) <= most), F.struct(F.when(s["lines"] == 0, x).otherwise(F.concat(s["text"], F.lit("\n"), x)).alias("text"), (s["n"] + F.char_length(x)).alias("n"), (s["lines"] + 1).alias("lines"), F.lit(True).alias("open"))).otherwise(F.struct(s["text"].alias("text"), s["n"].alias("n"), s["lines"].alias("lines"), F.lit(False).alias("open")))
    # more than most + 1 lines cannot fit unless they are empty; the first most characters and as many breaks tell all
    text = F.aggregate(F.split(c, "\n", -1), start, step, lambda s: s["text"])
    return F.concat(text, F.when(F.char_length(c) > F.char_length(text), "...").otherwise(""))


def first_lines(content: Column | str, n: int = 3) -> Column:
    lines = F.split(_c(content), "\n", -1)
    return F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.when(F.size(lines) > n, "...").otherwise(""))


def keywords(text: Column | str, most: int = 10) -> Column:
    """The first words of more than three letters or digits, in lower case; repeats stay."""
    words = F.filter(F.split(_c(text), r"\s+"), lambda w: (F.char_length(w) > 3) & w.rlike(r"^[\p{L}\p{N}]+$"))
    return F.slice(F.transform(words, F.lower), 1, most)


def intent_category(text: Column | str) -> Column:
    low, out = F.lower(_c(text)), F.lit("general")
    for name, words, _ in K.INTENT_RULES:
        out = F.when(_any(low, words), name).otherwise(out)
    return F.when(low.isNotNull(), out)


def suggested_types(text: Column | str) -> Column:
    low = F.lower(_c(text))
    parts = [F.when(_any(low, words), F.array(*map(F.lit, types))).otherwise(F.array().cast("array<string>")) for _, words, types in K.INTENT_RULES if types]
    return F.concat(*parts)


def task_scores(text: Column | str) -> Column:
    """Array of (score, order, task): for each task +1 per pattern within the text, +1 more if it stands between blanks.
    The text is lowered and padded once and bound to a name."""
    tasks = F.array(*[F.struct(F.lit(-n).alias("order"), F.lit(task).alias("task"), F.array(*map(F.lit, patterns)).alias("patterns")) for n, (task, patterns) in enumerate(K.TASK_PATTERNS.items())])
    once = lambda t: F.transform(tasks, lambda k: F.struct(F.aggregate(k["patterns"], F.lit(0), lambda n, p: n + F.when(t["low"].contains(p), 1 + t["padded"].contains(F.concat(F.lit(" "), p, F.lit(" "))).cast("int")).otherwise(0)).alias("score"), k["order"].alias("order"), k["task"].alias("task")))
    low = F.lower(_c(text))
    return F.transform(F.array(F.struct(low.alias("low"), F.concat(F.lit(" "), low, F.lit(" ")).alias("padded"))), once)[0]


def _task_types(texts: pd.Series) -> pd.Series:
    best = []
    for text in texts:
        if text is None:
            best.append(None)
            continue
        low = text.lower()
        padded, task, most = f" {low} ", K.DEFAULT_TASK, 0
        for name, patterns in K.TASK_PATTERNS.items():
            score = sum(1 + (f" {p} " in padded) for p in patterns if p in low)
            if score > most:
                task, most = name, score
        best.append(task)
    return pd.Series(best, dtype=object)


def task_type(text: Column | str) -> Column:
    """The task with the highest score (see task_scores), of equals the first; the default if none scores.

    In Python by Arrow batches: over the documents of sf0.1 on one core that took 3.5 s, the same expression in the JVM 13 s."""
    return F.pandas_udf(_task_types, "string")(_c(text))


def recommended_actions(task: Column | str, complex_names: Column | None = None, most: int = 5) -> Column:
    base = F.coalesce(F.element_at(F.create_map(*[x for k, v in K.ACTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), _c(task)), F.array().cast("array<string>"))
    if complex_names is not None:
        note = F.concat(F.lit("Pay special attention to complex functions: "), F.array_join(F.slice(complex_names, 1, 3), ", "))
        base = F.when(F.size(complex_names) > 0, F.concat(base, F.array(note))).otherwise(base)
    return F.slice(base, 1, most)


def chunk_starts(length: Column | str, width: int = 2048, overlap: int = 256) -> Column:
    """Where windows of fixed width begin that overlap and together cover a text."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), _c(length) - overlap - 1).cast("int"), F.lit(width - overlap))


def recipe_short(content: Column | str, signature: Column | str, name: Column | str, docstring: Column | str) -> Column:
    """Text to embed: the content; without it the signature or name and the beginning of the documentation."""
    full = lambda x: F.when(_c(x) != "", _c(x))
    doc = F.when(F.char_length(_c(docstring)) > 200, F.concat(F.substring(_c(docstring), 1, 200), F.lit("..."))).otherwise(full(docstring))
    return F.coalesce(full(content), F.concat_ws("\n", F.coalesce(full(signature), _c(name)), F.concat(F.lit("# "), doc)))


def recipe_full(kind: Column | str, name: Column | str, signature: Column | str, docstring: Column | str, content: Column | str) -> Column:
    part = lambda label, x: F.when(_c(x) != "", F.concat(F.lit(f"{label}: "), F.substring(_c(x), 1, 500) if label == "Content" else _c(x)))
    return F.concat_ws("\n", F.concat(_c(kind), F.lit(": "), F.coalesce(_c(name), F.lit(""))), part("Signature", signature), part("Documentation", docstring), part("Content", content))


def vector_document(kind: Column | str, name: Column | str, signature: Column | str, docstring: Column | str, content: Column | str) -> Column:
    """The text a vector stands for in the store of vectors; its parts are joined by a backslash and an n, as they always were."""
    full = lambda x: F.when(_c(x) != "", _c(x))
    body = F.when(F.char_length(_c(content)) > 1000, F.concat(F.substring(_c(content), 1, 1000), F.lit("..."))).otherwise(full(content))
    return F.concat_ws("\\n", F.concat(_c(kind), F.lit(": "), _c(name)), full(signature), full(docstring), F.concat(F.lit("Content: "), body))


def text_semantics(content: Column | str) -> Column:
    """Struct of import lines and flags, found without parsing."""
    lines = F.transform(F.split(_c(content), "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r\f\v")))
    return F.struct(
        F.filter(lines, lambda x: x.startswith("import ") | x.startswith("from ")).alias("imports"),
        F.exists(lines, lambda x: x.contains("try:")).alias("has_try"),
        F.exists(lines, lambda x: x.contains("if ") | x.contains("elif ") | x.contains("else:")).alias("has_conditionals"),
        F.exists(lines, lambda x: x.contains("for ") | x.contains("while ")).alias("has_loops"),
    )


def side_effect_families(name: Column | str) -> Column:
    """Array of ``family: name`` for each family one of whose words is within the name."""
    low = F.lower(_c(name))
    return F.filter(F.array(*[F.when(_any(low, words), F.concat(F.lit(f"{family}: "), low)) for family, words in K.SIDE_EFFECT_WORDS.items()]), lambda x: x.isNotNull())


def side_effect_bucket(effect: Column | str) -> Column:
    low = F.lower(_c(effect))
    return F.when(low.contains("io"), "io_operations").when(low.contains("state"), "state_modifications").otherwise("external_calls")


def explanation(reason: Column | str, score: Column | str, kind: Column | str, types: list[str], language: Column | str, languages: list[str]) -> Column:
    shown = F.format_string("%.2f", _c(score).cast("double"))
    clauses = [
        F.when(_c(reason) == "semantic_similarity", F.concat(F.lit("Semantically similar to query (score: "), shown, F.lit(")"))),
        F.when(_c(reason) == "graph_traversal", F.concat(F.lit("Related through code relationships (score: "), shown, F.lit(")"))),
        F.when(_c(kind).isin(types), F.concat(F.lit("Matches requested entity type: "), _c(kind))) if types else F.lit(None).cast("string"),
        F.when(_c(language).isin(languages), F.concat(F.lit("Matches language filter: "), _c(language))) if languages else F.lit(None).cast("string"),
    ]
    text = F.concat_ws("; ", *clauses)
    return F.when(text == "", "General relevance match").otherwise(text)


def location(path: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.concat(_c(path), F.lit(":"), _c(start).cast("string"), F.lit("-"), _c(end).cast("string"))


def line_count(start: Column | str, end: Column | str) -> Column:
    return F.greatest(F.lit(1), _c(end) - _c(start) + 1)


def file_size(size: Column | str) -> Column:
    s = _c(size).cast("double")
    out = F.format_string("%.1f TB", s / 1024.0**4)
    for n, unit in reversed(list(enumerate(["B", "KB", "MB", "GB"]))):
        out = F.when(s < 1024.0 ** (n + 1), F.format_string(f"%.1f {unit}", s / 1024.0**n)).otherwise(out)
    return F.when(s.isNotNull(), out)


def duration(seconds: Column | str) -> Column:
    s = _c(seconds).cast("double")
    return F.when(s < 60, F.format_string("%.1fs", s)).when(s < 3600, F.format_string("%.1fm", s / 60)).when(s.isNotNull(), F.format_string("%.1fh", s / 3600))


def cache_key(repository: Column | str, text: Column | str, most: int, threshold: float, types: list[str], languages: list[str], include_related: bool = True) -> Column:
    """Digest of a request: of its text without case and outer white space and of all its options."""
    parts = [_c(repository), F.lower(F.trim(_c(text))), F.lit(str(most)), F.lit(str(threshold)), F.lit("|".join(sorted(types))), F.lit("|".join(sorted(languages))), F.lit(str(include_related))]
    return F.md5(F.concat_ws("|", *parts))


# languages and normal forms


def normal_language(language: Column | str) -> Column:
    low = F.lower(F.trim(_c(language)))
    return F.coalesce(F.element_at(_map(K.LANGUAGE_ALIASES), low), low)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def suffix(path: Column | str) -> Column:
    """The extension of a path with its dot, in lower case; empty for names like .name or without a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def detect_language(path: Column | str) -> Column:
    """The language of a file by its name, else by its ending; null if unknown."""
    low = F.lower(base_name(path))
    kube = F.when(low.rlike(rf"-(?:{'|'.join(K.KUBERNETES_KINDS)})\.ya?ml$"), "yaml")
    return F.coalesce(F.element_at(_map(K.LANGUAGE_BY_NAME), low), kube, F.element_at(_map(K.LANGUAGE_BY_EXTENSION), suffix(path)))


def normal_path(path: Column | str) -> Column:
    return F.replace(_c(path), F.lit("\\"), F.lit("/"))


def qualified_name(path: Column | str, name: Column | str) -> Column:
    return F.concat(F.replace(F.regexp_replace(normal_path(path), r"\.[^./]*$", ""), F.lit("/"), F.lit(".")), F.lit("."), _c(name))


# predicates


def overlaps(a0: Column | str, a1: Column | str, b0: Column | str, b1: Column | str) -> Column:
    return (_c(a0) <= _c(b1)) & (_c(b0) <= _c(a1))


def contains_line(start: Column | str, end: Column | str, line: Column | int) -> Column:
    return (F.lit(line) if isinstance(line, int) else line).between(_c(start), _c(end))


def is_stale(indexed: Column | str, modified: Column | str) -> Column:
    return _c(indexed).isNull() | _c(modified).isNull() | (_c(modified) > _c(indexed))


def needs_rebuild(built: Column | str, now: Column, hours: float = 24.0) -> Column:
    return _c(built).isNull() | ((now.cast("double") - _c(built).cast("timestamp").cast("double")) / 3600.0 > hours)


def entity_problems() -> Column:
    """Array of the rules that an entity row breaks."""
    c = F.col
    rules = {
        "type": c("entity_type").isNull() | ~c("entity_type").isin(K.ENTITY_TYPES),
        "name": c("name").isNull() | (c("name") == ""),
        "lines": c("end_line") < c("start_line"),
        "first_line": c("start_line") < 1,
        "columns": (c("start_line") == c("end_line")) & (c("end_column") < c("start_column")),
        "path": c("file_path").isNull() | (c("file_path") == "") | c("file_path").startswith("/") | c("file_path").rlike("^.:"),
        "vector": F.exists("embedding_vector", lambda x: F.abs(x) > 100),
    }
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), n) for n, bad in rules.items()]), lambda x: x.isNotNull())


def relationship_problems() -> Column:
    c = F.col
    rules = {
        "type": c("type").isNull() | ~c("type").isin(K.RELATIONSHIP_TYPES),
        "ends": c("src").isNull() | c("dst").isNull(),
        "self": c("src") == c("dst"),
        "strength": ~c("strength").between(0, 1),
        "context": F.char_length("context") > 1000,
    }
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), n) for n, bad in rules.items()]), lambda x: x.isNotNull())


def repository_problems(now: Column) -> Column:
    c = F.col
    rules = {
        "hash": ~F.lower(F.trim("git_hash")).rlike("^[0-9a-f]{7,40}$"),
        "future": (c("last_indexed") > now) | (c("last_modified") > now),
        "counts": (c("size_bytes") < 0) | (c("file_count") < 0) | F.exists(F.map_values("language_stats"), lambda x: x < 0),
    }
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), n) for n, bad in rules.items()]), lambda x: x.isNotNull())
