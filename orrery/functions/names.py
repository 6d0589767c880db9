"""Scalar functions on names, paths and texts: Column in, Column out, all of them built-in expressions."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decorators that make a function a route.
ROUTES = "api_route delete get head options patch post put".split()
_CODE_ROOTS = ["", ".", *"app java lib main src".split()]
_DOMAIN_ROOTS = "apps domain domains modules packages services".split()
_PARAMETER = ":[A-Za-z_]" + "[A-Za-z0-9_]*"
#: Suffixes by the stereotype they tell, in the order in which they are tried.
SUFFIXES = [tuple(x.split(":")) for x in "ServiceImpl:Service Controller:Controller Repository:Repository Repo:Repository Service:Service Gateway:Gateway Client:Gateway Middleware:Middleware Interceptor:Middleware Filter:Middleware Config:Configuration Configuration:Configuration Entity:Entity Model:Entity Worker:Worker Handler:Controller Router:Controller Component:UI_Component".split()]
FOLDERS = {d: s.replace("_", " ") for s, names in {
    "Controller": "controller controllers", "Service": "service services", "Repository": "repo repos repository repositories", "Entity": "entities models",
    "Middleware": "middleware", "Gateway": "adapters clients gateways", "Configuration": "config configs", "UI_Component": "components",
}.items() for d in names.split()}
ANNOTATIONS = {
    "java": "RestController:Controller Controller:Controller Service:Service Repository:Repository Entity:Entity Component:Component Configuration:Configuration Bean:Configuration FeignClient:Gateway Aspect:Middleware ControllerAdvice:Middleware",
    "typescript": "Controller:Controller Injectable:Service Entity:Entity Component:UI_Component Module:Configuration NgModule:Configuration Middleware:Middleware Guard:Middleware Interceptor:Middleware Pipe:Component",
    "python": "dataclass:Entity service:Service repository:Repository component:Component route:Controller router:Controller " + " ".join(f"{m}:Controller" for m in ROUTES),
}
#: What a supertype tells, tried in this order.
BASES = [(r"\w*Repository\b", "Repository"), (r"(^|\.)(Pure)?Component\b", "UI Component"), (r"\b(APIView|ViewSet|GenericAPIView)\b", "Controller"), (r"\b(BaseHTTPMiddleware|MiddlewareMixin)\b", "Middleware"), (r"\b(BaseModel|Model|PO|I_Persistent)\b", "Entity"), (r"(^|\.)[IX]_[A-Z]?\w*$", "Entity")]


def _first(*options: Column) -> Column:
    return F.coalesce(*options)


def slug(column: Column, default: str) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 a dash, none outside."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.trim(column)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(text == "", F.lit(default)).otherwise(text)


def capability_id(name: Column) -> Column:
    return slug(name, "capability")


def guess_title(name: Column, stereotype: Column) -> Column:
    """A readable title: a role suffix goes, camel case is spaced; names in capitals stay."""
    base = F.coalesce(F.nullif(F.regexp_extract(name, "^(.+?)(RestController|Controller|Resource|Router|Handler|Gateway|Job|Worker|Batch)$", 1), F.lit("")), name)
    loud = (F.upper(base) == base) & (F.lower(base) != base) & (F.length(base) >= 4)
    spaced = F.trim(F.regexp_replace(F.regexp_replace(base, "([a-z])([A-Z])", "$1 $2"), "[_-]+", " "))
    title = F.concat(F.upper(F.substring(spaced, 1, 1)), F.substr(spaced, F.lit(2)))
    low = F.lower(title)
    title = F.when((stereotype == "Batch Job") & ~low.contains("job"), F.concat(title, F.lit(" batch"))).when((stereotype == "Gateway") & ~low.contains("gateway"), F.concat(title, F.lit(" gateway"))).otherwise(title)
    return F.when(loud, base).when(spaced == "", name).otherwise(title)


def package_token(file_path: Column, language: Column) -> Column:
    """The part of a path that names its domain."""
    parts = F.filter(F.split(F.replace(file_path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin(_CODE_ROOTS))
    at = F.filter(F.transform(parts, lambda p, i: F.when(F.lower(p).isin(_DOMAIN_ROOTS), i)), lambda i: i.isNotNull())
    after = F.replace(F.get(parts, F.get(at, F.lit(0)) + 1), F.lit("-"), F.lit("_"))
    java = F.when(language == "java", F.nullif(F.regexp_extract(F.concat(F.lit("/"), file_path), r"/(?:com|org|net)/\w+/(\w+)/", 1), F.lit("")))
    first = F.get(parts, F.lit(0))
    return F.coalesce(after, java, F.when((F.size(parts) >= 2) & first.isin("test", "tests"), F.get(parts, F.lit(1))).otherwise(first))


def url_path(url: Column) -> Column:
    """The path of a URL: no scheme, host, query or closing slash; it begins with a slash."""
    path = F.regexp_replace(url, "^https?://[^/]+", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    path = F.regexp_replace(F.regexp_replace(path, r"\?.*$", ""), "/+$", "")
    return F.when(path == "", "/").otherwise(path)


def path_pattern(template: Column) -> Column:
    """The whole-string pattern of a path template: {name} and :name stand for one segment."""
    plain = F.regexp_replace(template, r"([.+*?^$()\[\]|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(plain, r"\{[^}]+\}", "[^/]+"), _PARAMETER, "[^/]+"), F.lit("$"))


def paths_match(call: Column, template: Column) -> Column:
    flat = lambda c: F.regexp_replace(F.regexp_replace(c, r"\{[^}]+\}", "X"), _PARAMETER, "X")
    return (call == template) | (flat(call) == flat(template)) | F.rlike(call, path_pattern(template))


def make_id(file_path: Column, name: Column) -> Column:
    """A dotted id from a path without its ending, followed by the name unless it ends so already."""
    stem = F.regexp_replace(F.regexp_replace(F.replace(file_path, F.lit("\\"), F.lit("/")), r"\.[^./]+$", ""), "/__init__$", "")
    dotted = F.replace(stem, F.lit("/"), F.lit("."))
    return F.when((dotted == name) | dotted.endswith(F.concat(F.lit("."), name)), dotted).otherwise(F.concat(dotted, F.lit("."), name))


def fk_target(fk: Column) -> Column:
    """The table that a foreign key column points to, by its name."""
    return F.when(fk.rlike("^.+(_ID|_id)$"), F.regexp_replace(fk, "_(ID|id)$", "")).when(fk.rlike("^.+Id$"), F.regexp_replace(fk, "Id$", "")).otherwise(fk)


def fk_columns(columns: Column, table: Column) -> Column:
    """The columns that look like keys of other tables: they end in _ID, _id or Id and aren't the table's own."""
    own = F.lower(F.replace(table, F.lit("_"), F.lit("")))
    return F.filter(columns, lambda c: c.rlike("(_ID|_id|Id)$") & (F.lower(F.replace(fk_target(c), F.lit("_"), F.lit(""))) != own) & ~F.lower(c).isin("id", "_id"))


def table_of(name: Column) -> Column:
    """A table's name from a type's: prefixes I_, X_ and DCL or an entity suffix go."""
    bare = F.when(name.rlike("^[IX]_."), F.substr(name, F.lit(3))).when(name.rlike("^(?i:dcl)."), F.substr(name, F.lit(4)))
    return F.coalesce(bare, F.nullif(F.regexp_extract(name, "^(.+?)(Entity|Model|PO|DTO|Record)$", 1), F.lit("")), name)


def split_list(column: Column) -> Column:
    """The parts of a list written with commas or blanks."""
    return F.filter(F.split(column, r"[\s,]+"), lambda x: x != "")


def repo_slug(project: Column, path: Column, default: str = "My Application") -> Column:
    """A repository's slug: of its project's name unless that is the default, else of its path's last part."""
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return slug(F.when((project != default) & (F.trim(project) != ""), project).otherwise(last), "repo")


def display_name(key: Column, fallback: Column, canonical: list[str]) -> Column:
    """How a canonical entity is written: as the semantics write it, else as the model does, else as its key."""
    table = {c.lower(): c for c in reversed(canonical)}
    told = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key] if table else F.lit(None).cast("string")
    return F.coalesce(told, F.nullif(fallback, F.lit("")), key)


def base_name(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, "^(.+?)(Controller|Service|Resource|Router)$", 1), F.lit("")), name)


def safe_id(name: Column) -> Column:
    """An identifier: other characters are underscores, and none begins with a digit."""
    flat = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    return F.when(flat.rlike("^[0-9]") | (flat == ""), F.concat(F.lit("n_"), flat)).otherwise(flat)


def is_licence(line: Column) -> Column:
    return F.lower(line).rlike("licen[sc]ed under|copyright|all rights reserved|apache licen[sc]e|spdx")


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(r"/tests?/|^tests?/|\.test\.|\.spec\.|(^|/)test_")


def glob_pattern(glob: str) -> str:
    """A whole-string regular expression that Java and Python read alike."""
    return "^(?s:" + re.sub(r"\\Z$|\\z$", "", fnmatch.translate(glob)).removeprefix("(?s:").removesuffix(")") + ")$"


def matches_any(column: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | column.rlike(glob_pattern(g))
    return out


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether a path, its file name or any segment matches one of the globs."""
    return matches_any(path, globs) | F.exists(F.split(path, "/"), lambda s: matches_any(s, globs))


def language_of(path: Column) -> Column:
    """The language by the file's ending; null for others."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ending == "java", "java").when(ending.isin("ts", "tsx"), "typescript").when(ending.isin("js", "jsx"), "javascript").when(ending == "py", "python").when(ending.isin("cbl", "cob", "cpy", "dcl"), "cobol").when(ending.isin("jcl", "proc"), "jcl").when(ending == "bms", "bms")


def container_of(container: Column, path: Column) -> Column:
    """The given container, else the path's first segment."""
    return F.coalesce(container, F.get(F.split(path, "/"), F.lit(0)))


def by_annotation(annotations: Column, language: Column) -> Column:
    """What the first telling annotation says."""
    short = F.transform(annotations, lambda a: F.regexp_replace(F.regexp_replace(a, r"\(.*$", ""), r"^@?(?:.*\.)?", ""))
    out = None
    for lang, pairs in ANNOTATIONS.items():
        table = F.create_map(*[F.lit(x) for p in pairs.split() for a, b in [p.split(":")] for x in (a, b.replace("_", " "))])
        told = F.get(F.filter(F.transform(short, table.getItem), lambda x: x.isNotNull()), F.lit(0))
        names = ["typescript", "javascript"] if lang == "typescript" else [lang]
        out = F.when(language.isin(names), told) if out is None else out.when(language.isin(names), told)
    return out


def by_bases(bases: Column) -> Column:
    def one(b: Column) -> Column:
        out = None
        for pattern, stereotype in BASES:
            out = F.when(b.rlike(pattern), stereotype) if out is None else out.when(b.rlike(pattern), stereotype)
        return out

    return F.get(F.filter(F.transform(bases, one), lambda x: x.isNotNull()), F.lit(0))


def by_name(name: Column) -> Column:
    out = F.when(name.rlike(r"^[IX]_[A-Z]\w*$"), "Entity")
    for suffix, stereotype in SUFFIXES:
        out = out.when(name.endswith(suffix) & (name != suffix), stereotype.replace("_", " "))
    return out


def by_folder(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])
    return F.get(F.filter(F.transform(F.split(path, "/"), lambda p: table[F.lower(p)]), lambda x: x.isNotNull()), F.lit(0))


def stereotype(language: Column, name: Column, path: Column, annotations: Column, bases: Column, custom: Column | None = None, convention: Column | None = None) -> Column:
    """The cascade: annotations (``custom`` ones first), then supertypes, then the name's suffix, then folders (a ``convention``
    first), then Component."""
    none = F.lit(None).cast("string")
    return _first(none if custom is None else custom, by_annotation(annotations, language), by_bases(bases), by_name(name), none if convention is None else convention, by_folder(path), F.lit("Component"))


def host_stereotype(a: dict[str, Column], override: Column | None = None) -> Column:
    """A mainframe program's stereotype from flags: copybook, maps, queue, data, linked, executed, job."""
    out = F.when(a["copybook"], "Shared Data").when(a["maps"], "UI Component").when(a["queue"], "Gateway").when(a["data"], "Repository").when(a["linked"], "Service").when(a["executed"] | a["job"], "Batch Job").otherwise("Component")
    return out if override is None else F.coalesce(override, out)
