"""Names, weights, word lists and patterns that results depend on."""

# fixed values: enumerations
ENTITY_TYPES = ["FILE", "MODULE", "CLASS", "FUNCTION", "METHOD", "VARIABLE", "CONSTANT", "INTERFACE", "ENUM", "STRUCT", "NAMESPACE", "PROPERTY", "FIELD"]
RELATIONSHIP_TYPES = ["IMPORTS", "CALLS", "INHERITS", "IMPLEMENTS", "CONTAINS", "REFERENCES", "DEPENDS_ON", "EXTENDS", "OVERRIDES", "INSTANTIATES", "ANNOTATES", "DECORATES", "ACCESSES"]
DIRECTIONS = ["outgoing", "incoming", "bidirectional"]

# fixed values: relationship classes, reverses and descriptions
STRUCTURAL = ["INHERITS", "IMPLEMENTS", "CONTAINS", "EXTENDS"]
BEHAVIORAL = ["CALLS", "ACCESSES", "INSTANTIATES"]
DEPENDENCY = ["IMPORTS", "DEPENDS_ON", "REFERENCES", "CALLS"]
REVERSE_TYPE = {"INHERITS": "EXTENDS", "EXTENDS": "INHERITS"}
DESCRIPTIONS = {
    "IMPORTS": "imports", "CALLS": "calls", "INHERITS": "inherits from", "IMPLEMENTS": "implements", "CONTAINS": "contains", "REFERENCES": "references", "DEPENDS_ON": "depends on",
    "EXTENDS": "extends", "OVERRIDES": "overrides", "INSTANTIATES": "creates instance of", "ANNOTATES": "is annotated with", "DECORATES": "decorates", "ACCESSES": "accesses",
}

# fixed values: weights of relationship types in multi-hop expansion and in graph relevance
HOP_WEIGHTS = {"CALLS": 0.9, "CONTAINS": 0.8, "INHERITS": 0.8, "IMPORTS": 0.7, "DEPENDS_ON": 0.7, "REFERENCES": 0.6}
GRAPH_WEIGHTS = {"CALLS": 0.9, "IMPORTS": 0.8, "INHERITS": 0.8, "CONTAINS": 0.7, "REFERENCES": 0.6, "DEPENDS_ON": 0.6}
OTHER_WEIGHT, HOP_DECAY, HOP_THRESHOLD, GRAPH_DAMPING = 0.5, 0.8, 0.3, 0.7

# fixed values: language names by alias, and languages by file extension and by file name
LANGUAGE_ALIASES = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "cpp": "c++", "cxx": "c++", "cc": "c++", "c": "c", "java": "java", "kt": "kotlin",
    "rb": "ruby", "go": "go", "rs": "rust", "php": "php", "cs": "c#", "fs": "f#", "vb": "vb.net", "swift": "swift", "scala": "scala", "clj": "clojure", "hs": "haskell",
}
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".cpp": "cpp", ".cxx": "cpp", ".cc": "cpp", ".c": "c", ".h": "c",
    ".hpp": "cpp", ".cs": "c_sharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".clj": "clojure", ".hs": "haskell",
    ".ml": "ocaml", ".fs": "fsharp", ".lua": "lua", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".ini": "ini",
    ".xml": "xml", ".html": "html", ".css": "css", ".scss": "scss", ".sql": "sql", ".tf": "hcl", ".hcl": "hcl", ".dockerfile": "dockerfile", ".md": "markdown", ".rst": "rst", ".tex": "latex",
}
KUBERNETES_KINDS = ["deployment", "service", "configmap", "secret", "ingress"]
LANGUAGE_BY_NAME = {
    "dockerfile": "dockerfile", "docker-compose.yml": "yaml", "docker-compose.yaml": "yaml", "makefile": "makefile", "rakefile": "ruby", "gemfile": "ruby", "podfile": "ruby",
    "vagrantfile": "ruby", "cmakelists.txt": "cmake", ".gitignore": "gitignore", ".dockerignore": "gitignore",
} | {f"{k}.{e}": "yaml" for k in KUBERNETES_KINDS for e in ("yaml", "yml")}

# fixed values: words that tell a query's intent; of the rules that match, the last names the category
INTENT_RULES = [
    ("function_related", ["function", "method", "def", "implement"], ["FUNCTION"]),
    ("class_related", ["class", "object", "inheritance"], ["CLASS"]),
    ("variable_related", ["variable", "constant", "property"], ["VARIABLE", "CONSTANT"]),
    ("import_related", ["import", "module", "package"], ["MODULE"]),
    ("api_related", ["api", "endpoint", "route"], []),
    ("test_related", ["test", "testing", "unittest"], []),
    ("debugging", ["bug", "fix", "error", "issue"], []),
]

# fixed values: words that tell a task's type, in the order in which ties are decided
TASK_PATTERNS = {
    "debug": ["debug", "error", "exception", "bug", "issue", "problem", "crash", "not working", "failing", "broken", "trace", "stack trace"],
    "refactor": ["refactor", "restructure", "reorganize", "clean up", "improve structure", "extract", "rename", "move", "simplify", "redesign"],
    "implement_feature": ["implement", "add", "create", "build", "new feature", "functionality", "capability", "enhancement", "feature request"],
    "optimize": ["optimize", "performance", "speed up", "efficiency", "faster", "memory", "cpu", "bottleneck", "profiling", "benchmark"],
    "test_write": ["test", "testing", "unit test", "integration test", "coverage", "test case", "assertion", "mock", "spec"],
    "bug_fix": ["fix", "resolve", "solve", "correct", "patch", "repair", "address issue", "handle error"],
    "api_integration": ["api", "integrate", "service", "endpoint", "request", "response", "http", "rest", "graphql", "webhook"],
    "code_review": ["review", "check", "examine", "audit", "quality", "standards", "best practices", "security", "maintainability"],
}
DEFAULT_TASK = "implement_feature"

# fixed values: (priority types, depth, most results, threshold) by task type
TASK_SETTINGS = {
    "debug": (["FUNCTION", "CLASS"], 3, 15, 0.4),
    "refactor": (["FUNCTION", "CLASS", "MODULE"], 2, 20, 0.3),
    "implement_feature": (["CLASS", "FUNCTION", "MODULE"], 2, 25, 0.25),
    "optimize": (["FUNCTION", "CLASS"], 3, 12, 0.5),
    "test_write": (["FUNCTION", "CLASS"], 2, 10, 0.6),
    "bug_fix": (["FUNCTION", "CLASS"], 4, 18, 0.3),
    "api_integration": (["FUNCTION", "CLASS", "MODULE"], 2, 15, 0.4),
    "code_review": (["FUNCTION", "CLASS"], 2, 30, 0.2),
}

# fixed values: recommended actions by task type
ACTIONS = {
    "debug": ["Check error handling patterns in related functions", "Trace execution flow through call graph", "Examine side effects and state modifications", "Look for similar error patterns in the codebase"],
    "refactor": ["Identify functions that can be extracted or combined", "Check for code duplication across related entities", "Analyze dependency relationships for reorganization opportunities", "Consider interface consistency across similar components"],
    "implement_feature": ["Study existing patterns in similar functionality", "Identify interfaces and contracts to follow", "Check for reusable components in the codebase", "Plan integration points with existing systems"],
    "bug_fix": ["Examine control flow and edge cases", "Check input validation and error handling", "Trace data flow through the problematic code", "Look for related fixes in version history"],
}

# fixed values: path patterns of files that are no source code
DEPENDENCY_PATTERNS = [
    "venv/", ".venv/", "env/", "ENV/", "__pycache__/", "*.egg-info/", "site-packages/", "pip-log.txt", "pip-delete-this-directory.txt", "node_modules/", "npm-debug.log*", "yarn-debug.log*",
    "yarn-error.log*", ".npm/", ".yarn/", "bower_components/", "vendor/", ".bundle/", "Gemfile.lock", "composer.lock", "target/", ".m2/", ".gradle/", "gradle/", "build/", "cmake-build-*/",
    ".cmake/", "bin/", "obj/", "packages/", ".nuget/", "go.sum", "Cargo.lock", ".pnpm-store/", "jspm_packages/", "typings/",
]
TEST_PATTERNS = [
    "test/", "tests/", "spec/", "specs/", "__tests__/", "testing/", "*test*/", "*spec*/", "*mock*/", "fixtures/", "mocks/", "*.test.py", "*.spec.py", "*.test.js", "*.spec.js", "*.test.ts",
    "*.spec.ts", "test_*.py", "spec_*.py", "*_test.py", "*_spec.py", "*Test.java", "*Spec.java", "*Tests.java", "TestCase*.php", "*Test.php", "*TestCase.php", "test*.go", "*_test.go",
    "test*.c", "test*.cpp", "*_test.c", "*_test.cpp",
]
BUILD_PATTERNS = [
    "dist/", "build/", "out/", "target/", "bin/", "obj/", ".next/", ".nuxt/", ".output/", "public/build/", "coverage/", "htmlcov/", ".coverage", ".nyc_output/", ".cache/", ".parcel-cache/",
    ".webpack-cache/", "*.min.js", "*.min.css", "*.bundle.js", "*.chunk.js", "*.map", "*.d.ts", "*.tsbuildinfo",
]
DOC_CONFIG_PATTERNS = [
    "docs/", "doc/", "documentation/", "man/", "manual/", "examples/", "samples/", "demo/", "demos/", "tutorial/", "tutorials/", ".github/", ".gitlab/", ".vscode/", ".idea/", ".vs/", "*.md",
    "*.txt", "*.rst", "*.adoc", "README*", "CHANGELOG*", "LICENSE*", "Dockerfile*", "docker-compose*.yml", ".dockerignore", "Makefile*", "*.mk", "CMakeLists.txt", "configure*", "*.yml",
    "*.yaml", "*.toml", "*.ini", "*.cfg", "*.conf", "*.config", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "requirements*.txt", "Pipfile*", "poetry.lock",
    "pyproject.toml", "setup.py", "setup.cfg", "MANIFEST.in", "tox.ini", ".gitignore", ".gitattributes", ".editorconfig", ".pre-commit*",
]
SYSTEM_PATTERNS = [".git/", ".svn/", ".hg/", ".bzr/", ".DS_Store", "Thumbs.db", "desktop.ini", "*.tmp", "*.temp", "*.log", "*.bak", "*.swp", "*.swo", ".env*", ".local", "*.pid", "*.lock"]

# fixed values: extensions of source files
SOURCE_EXTENSIONS = [
    ".py", ".pyx", ".pyi", ".js", ".mjs", ".jsx", ".ts", ".tsx", ".java", ".kt", ".kts", ".scala", ".cs", ".cpp", ".cc", ".cxx", ".c++", ".hpp", ".hh", ".hxx", ".h++", ".c", ".h", ".go", ".rs",
    ".php", ".php3", ".php4", ".php5", ".phtml", ".rb", ".rbw", ".swift", ".m", ".mm", ".sql", ".sh", ".bash", ".zsh", ".fish", ".ps1", ".psm1", ".lua", ".pl", ".pm", ".r", ".R", ".dart",
    ".ex", ".exs", ".erl", ".hrl", ".hs", ".lhs", ".clj", ".cljs", ".cljc", ".vue",
]

# fixed values: words that tell side effects by family, in this order
SIDE_EFFECT_WORDS = {
    "file_io": ["open", "read", "write", "close"],
    "database": ["execute", "query", "commit", "rollback"],
    "network": ["request", "get", "post", "fetch"],
    "logging": ["log", "debug", "info", "warning", "error"],
    "global_state": ["global", "nonlocal"],
}
BUILTIN_CALLS = ["print", "len", "str", "int", "list", "dict"]
IO_CALL_WORDS = ["print", "write", "save", "delete", "update"]
