"""Structured and natural-language questions over a snapshot.

A question is turned into a :class:`Spec` on the driver, and that into a DataFrame. Tier 1 is a list of patterns, tried in
order; tier 2 looks for element names in the question; tier 3 gives a hint and some elements. Unlike the tool this follows,
plurals such as "repositories" are understood.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph as G
from .operators import relational as R

_WORD = r"([\w.:#-]+)"
#: mode, patterns; the groups are the arguments.
PATTERNS = [
    ("upstream", [rf"what depends on {_WORD}", rf"who (?:uses|calls) {_WORD}", rf"dependents of {_WORD}"]),
    ("downstream", [rf"what does {_WORD} (?:depend on|use|call)", rf"dependencies of {_WORD}"]),
    ("cite", [rf"where is {_WORD}", rf"find file (?:for )?{_WORD}", rf"\bcite {_WORD}"]),
    ("path", [rf"(?:show|trace|path)\b.{{0,20}}?\bfrom {_WORD} (?:to|→|->) {_WORD}", rf"how does {_WORD} (?:reach|get to) {_WORD}", rf"(?:trace|path) {_WORD} (?:to|→|->) {_WORD}"]),
    ("stereotype", [r"(?:find|list|show) (?:all |the )?([a-z ]+?)\s*\??$", r"how many ([a-z ]+?)(?: are there)?\s*\??$"]),
    ("group", [r"\b(?:overview|summary)\b", r"group by (?:layer|stereotype)", r"how is (?:the )?(?:architecture|project|system) (?:built|structured)"]),
]
_VERB = re.compile(r"\b(depend|depends|use|uses|call|calls|impact|affect)\w*\b")


@dataclass(frozen=True)
class Spec:
    """What a question asks: mode (all, group, stereotype, cite, upstream, downstream, both, path, names), arguments, tier."""

    mode: str
    args: tuple[str, ...] = ()
    tier: str = "tier1"


def stereotype_of(words: str) -> str | None:
    """The stereotype that words name, in the singular or plural."""
    w = words.strip().replace(" ", "_")
    for option in (w, w.removesuffix("s"), re.sub("ies$", "y", w)):
        if option in R.ALIASES:
            return R.ALIASES[option]
    return None


def parse(question: str) -> Spec | None:
    """The tier-1 reading of a question, if it has one."""
    q = question.strip().lower()
    if not q:
        return Spec("all")
    for mode, patterns in PATTERNS:
        for p in patterns:
            if m := re.search(p, q):
                if mode == "stereotype":
                    if (s := stereotype_of(m[1])) is None:
                        continue
                    return Spec(mode, (s,))
                return Spec(mode, tuple(g.rstrip("?.") for g in m.groups()))
    return None


def structured(elements: DataFrame, edges: DataFrame, *, question: str | None = None, group_by: str | None = None, stereotype: str | None = None, element: str | None = None, direction: str = "both") -> DataFrame:
    """Question (only without other arguments), then grouping, stereotype, element; all elements otherwise."""
    if question and not (stereotype or element or group_by):
        return ask(elements, edges, question)
    if group_by in ("stereotype", "layer"):
        return answer(elements, edges, Spec("group"))
    if stereotype:
        return answer(elements, edges, Spec("stereotype", (stereotype,)))
    return answer(elements, edges, Spec(direction, (element,)) if element else Spec("all"))


def answer(elements: DataFrame, edges: DataFrame, spec: Spec) -> DataFrame:
    if spec.mode == "group":
        return R.counted(elements, "stereotype").orderBy(F.desc("n"), "stereotype")
    if spec.mode == "stereotype":
        return R.of_stereotype(elements, spec.args[0])
    if spec.mode == "cite":
        return R.listed(R.named(elements, spec.args[0]))
    if spec.mode in ("upstream", "downstream", "both"):
        return G.dependencies(elements, edges, spec.args[0], spec.mode)
    if spec.mode == "path":
        return G.shortest_path(elements, edges, G.ids_named(elements, spec.args[0]), G.ids_named(elements, spec.args[1]))
    return R.listed(elements)


def mentioned(elements: DataFrame, question: str) -> DataFrame:
    """Elements whose name (3 characters or more) the question contains, longest first."""
    return elements.where((F.length("name") >= 3) & F.lit(question.lower()).contains(F.lower("name"))).orderBy(F.desc(F.length("name")), "ord")


def ask(elements: DataFrame, edges: DataFrame, question: str) -> DataFrame:
    """The answer to a question by the first tier that has one."""
    if spec := parse(question):
        return answer(elements, edges, spec)
    names = mentioned(elements, question).select("name").limit(3)
    names = [r["name"] for r in names.toLocalIterator()]  # three at most
    if names:
        if _VERB.search(question.lower()):
            out = None
            for n in names:
                found = G.dependencies(elements, edges, n, "both")
                out = found if out is None else out.unionByName(found)
            return out.distinct()
        return R.listed(elements.where(F.col("name").isin(names)))
    return R.listed(elements.orderBy("ord").limit(10)).withColumn("hint", F.lit("ask what depends on a name, for a path, a stereotype or an overview"))


def read_all(questions: DataFrame) -> DataFrame:
    """mode of every row (question) of a table of questions, with the tier-1 patterns as one expression."""
    q = F.lower(F.trim("question"))
    mode = F.when(q == "", "all")
    known = F.create_map(*[F.lit(x) for k in R.ALIASES for x in (k.replace("_", " "), R.ALIASES[k])])
    for name, patterns in PATTERNS:
        for p in patterns:
            if name == "stereotype":
                w = F.regexp_extract(q, p, 1)
                hit = q.rlike(p) & F.coalesce(known[w], known[F.regexp_replace(w, "s$", "")], known[F.regexp_replace(w, "ies$", "y")]).isNotNull()
            else:
                hit = q.rlike(p)
            mode = mode.when(hit, name)
    return questions.withColumn("mode", mode)
