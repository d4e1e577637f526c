"""Expressions over a project's own texts: module names, README sections, Makefile names, WebAssembly text, issue texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: separators of module paths by file extension, weights of README sections by words of the title
DOTTED = ("py", "ts", "tsx", "js", "jsx", "java", "kt", "kts")
SECTIONS = {
    0.9: ("overview", "architecture", "api", "philosophy", "core concepts", "design principles"),
    0.6: ("features", "usage", "quickstart", "getting started", "installation", "configuration"),
    0.3: ("examples", "troubleshooting", "faq"),
    0.1: ("badges", "license", "contributing", "changelog", "acknowledgments", "sponsors"),
}
# fixed values: names in a Makefile that a summary keeps
TARGETS = ("all", "build", "test", "install", "clean", "release", "fmt", "format", "lint", "check", "coverage", "docs", "deploy", "run", "serve", "dev", "prod", "dist", "package")
VARIABLES = ("PROJECT_NAME", "VERSION", "CC", "CXX", "CARGO", "RUSTC", "PYTHON", "NODE", "NPM", "DOCKER", "KUBECTL", "CFLAGS", "LDFLAGS", "TARGET", "ARCH", "OS")
# fixed values: what tells AssemblyScript
SCRIPT = ("@global", "@inline", "@external", "i32", "f64", "memory.")
# fixed values: paths and module names in prose
QUOTED_PATH = r"`([a-zA-Z0-9_\-./]+\.[a-zA-Z0-9]+)`"
BARE_PATH = r"\b(?:[a-zA-Z0-9_\-]+/)*[a-zA-Z0-9_\-]+\.[a-zA-Z0-9]+\b"
MODULE_PATH = r"\b[a-zA-Z0-9_]+(?:::[a-zA-Z0-9_]+)+\b"
ISSUE_URL = r"github\.com/([^/]+)/([^/]+)/issues/(\d+)"


def module_path(path: Column) -> Column:
    """A path as a module name of its language, without source root, extension and a final index or mod."""
    ext = F.regexp_extract(path, r"\.([^./\\]+)$", 1)
    sep = F.when(ext.isin(*DOTTED), ".").when(ext == "go", "/").otherwise("::")
    bare = F.regexp_replace(F.regexp_replace(path, "^(src|lib|app)/", ""), r"([^/])\.[^./]*$", "$1")
    module = F.replace(F.replace(bare, F.lit("/"), sep), F.lit("\\"), sep)
    last = F.when(F.endswith(module, F.concat(sep, F.lit("index"))), "index").otherwise("mod")
    return F.regexp_replace(module, F.concat(F.lit("("), F.replace(sep, F.lit("."), F.lit("\\.")), last, F.lit(")+$")), F.lit(""))


def semantic_name(id: Column, label: Column, path: Column) -> Column:
    """A node's label if it says more than the id, else its module, else the id made readable. Nulls are empty."""
    id, label, path = (F.coalesce(c, F.lit("")) for c in (id, label, path))
    clean = id
    for prefix in ("node_", "module_", "file_"):
        clean = F.regexp_replace(clean, f"^({prefix})+", "")
    return F.when((label != "") & (label != id), label).when(path != "", module_path(path)).otherwise(F.translate(clean, "_", "."))


def section_score(title: Column, level: Column, paragraphs: Column, lists: Column) -> Column:
    """A README section's weight: the best of the words in its title, else by its level and content."""
    low = F.lower(title)
    score = None
    for weight, words in SECTIONS.items():
        found = low.rlike("|".join(words))
        score = F.when(found, weight) if score is None else score.when(found, weight)
    return score.when((level == 1) & (paragraphs > 0), 0.7).when((lists > 0) & low.contains("feature"), 0.7).otherwise(0.4)


def critical_target(name: Column) -> Column:
    return name.isin(*TARGETS) | name.rlike("^(docker|test-|build-)|deploy|install")


def critical_variable(name: Column) -> Column:
    return name.isin(*VARIABLES)


def count_of(text: Column, part: str) -> Column:
    """How often ``part`` is in the text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def n_lines(text: Column) -> Column:
    return count_of(text, "\n") + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)


def wasm_complexity(text: Column, keyword: str = "func") -> Column:
    """Two points a function and one for ten lines; AssemblyScript's keyword is ``function``."""
    return 2 * count_of(text, keyword) + F.floor(n_lines(text) / 10)


def is_assemblyscript(text: Column) -> Column:
    found = text.contains("export") & text.contains("function")
    for part in SCRIPT:
        found = found | text.contains(part)
    return found


def is_wat(text: Column) -> Column:
    return text.rlike(r"^\s*\(") & (text.contains("module") | text.contains("func"))


def issue_of(url: Column) -> Column:
    """(owner, repo, number) of an issue's address, null if it is none."""
    part = lambda k: F.regexp_extract(url, ISSUE_URL, k)
    return F.when(url.rlike(ISSUE_URL), F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).cast("long").alias("number")))


def issue_paths(text: Column, roots: tuple[str, ...] = ("src/", "server/src/")) -> Column:
    """The files that a text names, sorted: quoted or bare paths, and module names as files below each root."""
    modules = F.regexp_extract_all(text, F.lit(MODULE_PATH), F.lit(0))

    def below(root: str) -> Column:
        return F.transform(modules, lambda m: F.concat(F.lit(root), F.replace(m, F.lit("::"), F.lit("/")), F.lit(".rs")))

    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(QUOTED_PATH), F.lit(1)), F.regexp_extract_all(text, F.lit(BARE_PATH), F.lit(0)), *map(below, roots))))
