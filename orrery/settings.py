"""Project settings: what a repository's YAML says about stereotypes, containers, mainframe programs and folders."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import names as N

FILES = ("orrery.yaml", "orrery.yml", ".orrery/config.yaml")


def _first_of(options: list[Column]) -> Column:
    return F.coalesce(*options, F.lit(None).cast("string"))


@dataclass
class Settings:
    """``stereotypes``: by language, rules with ``annotation`` or ``decorator``, or with ``convention`` (a part of a path), and the
    ``stereotype``. ``containers``: rules with ``path`` (a glob or a folder) and ``name``. ``mainframe``: ``stereotypes`` with ``program``
    or ``program_pattern``, and ``transactions`` (transaction to program). Of several rules that hold the first counts."""

    project_name: str = "My Application"
    languages: list[str] = field(default_factory=lambda: ["java", "typescript", "javascript", "python", "cobol", "jcl", "bms"])
    stereotypes: dict[str, list[dict]] = field(default_factory=dict)
    containers: list[dict] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    ddl: dict = field(default_factory=dict)
    mainframe: dict = field(default_factory=dict)

    @classmethod
    def of(cls, data: dict | None) -> Settings:
        """From a mapping; ``schema`` is an old name of ``ddl``, unknown keys are passed over."""
        data = dict(data or {})
        data.setdefault("ddl", data.pop("schema", None) or {})
        return cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__ and v is not None})

    @classmethod
    def load(cls, folder: str) -> Settings:
        """From the first of ``FILES`` in a folder; without any the defaults."""
        from .overlays import load_yaml

        return cls.of(load_yaml(folder, *FILES))

    def by_annotation(self, annotations: Column, language: Column) -> Column:
        """What the first annotation with a rule says; names count without case, arguments and packages."""
        out = F.lit(None).cast("string")
        short = F.transform(annotations, lambda a: F.lower(F.regexp_replace(F.regexp_replace(a, r"\(.*$", ""), r"^@?(?:.*\.)?", "")))
        for lang, rules in self.stereotypes.items():
            told: dict[str, str] = {}
            for rule in rules:
                if key := rule.get("annotation") or rule.get("decorator"):
                    told.setdefault(key.lower(), rule["stereotype"])
            if told:
                table = F.create_map(*[F.lit(x) for kv in told.items() for x in kv])
                first = F.get(F.filter(F.transform(short, table.getItem), lambda x: x.isNotNull()), F.lit(0))
                out = F.when(language == lang, first).otherwise(out)
        return out

    def by_convention(self, path: Column, language: Column) -> Column:
        """What the first rule says whose part occurs in the path."""
        flat = F.replace(path, F.lit("\\"), F.lit("/"))
        rules = [(lang, r["convention"].replace("*", "").rstrip("/"), r["stereotype"]) for lang, rs in self.stereotypes.items() for r in rs if r.get("convention")]
        return _first_of([F.when((language == lang) & flat.contains(part), F.lit(s)) for lang, part, s in rules])

    def container(self, path: Column) -> Column:
        """The name of the first container whose glob matches or whose folder holds the path; null without one."""
        flat = F.replace(path, F.lit("\\"), F.lit("/"))
        options = []
        for rule in self.containers:
            glob = rule["path"].replace("\\", "/")
            prefix = glob.rstrip("*").rstrip("/")
            holds = flat.rlike(N.glob_pattern(glob))
            if prefix:
                holds = holds | (flat == prefix) | flat.startswith(prefix + "/")
            options.append(F.when(holds, F.lit(rule["name"])))
        return _first_of(options)

    def host_override(self, program: Column) -> Column:
        """What the first rule says about a mainframe program; names count without case."""
        options = []
        for rule in self.mainframe.get("stereotypes", []):
            holds = F.lit(False)
            if rule.get("program"):
                holds = holds | (F.upper(program) == rule["program"].upper())
            if rule.get("program_pattern"):
                holds = holds | F.upper(program).rlike(N.glob_pattern(rule["program_pattern"].upper()))
            options.append(F.when(holds, F.lit(rule["stereotype"])))
        return _first_of(options)

    @property
    def transactions(self) -> dict[str, str]:
        return {str(k).upper(): str(v).upper() for k, v in (self.mainframe.get("transactions") or {}).items()}

    def wants(self, path: str) -> bool:
        """Whether a path is none of the excluded ones."""
        return not any(fnmatch.fnmatchcase(path, g) for g in self.exclude)


def initial(folder: str, overwrite: bool = False) -> bool:
    """Write settings to start from; whether they were written."""
    from .overlays import save_yaml

    return save_yaml(str(Path(folder, FILES[0])), {"project_name": Path(folder).resolve().name, "languages": Settings().languages, "exclude": ["node_modules/*", "target/*", "build/*", "dist/*"], "containers": [], "stereotypes": {}}, overwrite)
