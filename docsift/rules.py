"""Rule sets: fields, aliases, vocabularies and formats as small tables to broadcast.

A rule set is read from YAML files laid out as ``fields`` (a list) and rule
blocks by name, or built from the same structures. Its tables hold at most a
few hundred rows, which is what makes broadcasting them safe.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.text import norm_label

#: What air-action notations stand for. The action on loss of air is the opposite of where air moves the valve.
FAIL_MAP = (
    (("AIR TO OPEN", "AIR-TO-OPEN", "ATO", "A/O"), "FAIL CLOSE"),
    (("AIR TO CLOSE", "AIR-TO-CLOSE", "ATC", "A/C"), "FAIL OPEN"),
    (("FAIL LAST", "FAIL IN PLACE", "FAIL LOCK"), "FAIL LAST"),
)
FAIL_DIRECT = (
    (("OPEN", "TO OPEN", "OPENS", "FO", "FAIL OPEN", "FAIL TO OPEN", "VALVE OPEN"), "FAIL OPEN"),
    (("CLOSE", "CLOSED", "TO CLOSE", "CLOSES", "FC", "FAIL CLOSE", "FAIL TO CLOSE", "VALVE CLOSE"), "FAIL CLOSE"),
    (("LOCK", "LAST", "IN PLACE", "LOCKED"), "FAIL LAST"),
)
#: What the letters of a tag say about the valve.
TAG_KINDS = {
    "FV": "Flow Control Valve",
    "LV": "Level Control Valve",
    "PV": "Pressure Control Valve",
    "TV": "Temperature Control Valve",
    "HV": "Hand Valve",
    "XV": "On-Off Valve",
}


def plain_label(label: object) -> str:
    """Upper case ASCII letters and digits, as ``functions.text.ascii_label``."""
    return re.sub("[^0-9A-Z]+", "", str(label or "").upper())


def _field(key, name, *, aliases=(), required=False, safety="normal", source="document", mvp=True, threshold=0.9, **more):
    return {"key": key, "name": name, "aliases": list(aliases), "required": required, "safety": safety, "source": source, "mvp": mvp, "threshold": threshold} | more


#: A small rule set of our own, for tests and demonstration queries.
DEFAULT = {
    "fields": [
        _field("type_name", "Type", source="derived", mvp=False),
        _field("tag", "Tag", aliases=["Tag No", "Item No"], required=True, safety="identity", threshold=0.95),
        _field("maker", "Manufacturer", aliases=["Maker", "Mfr"], required=True),
        _field("model", "Model", aliases=["Model No"], required=True),
        _field("body_size", "Body Size", aliases=["Size"], required=True, punctuation=True),
        _field("rating", "Rating", aliases=["Pressure Class", "Model No"], required=True),
        _field("rated_cv", "Rated Cv", aliases=["Cv"], numeric=True),
        _field("fail_action", "Fail Action", aliases=["Fail Position", "Air Fails Valve To"], required=True, safety="safety", threshold=0.95),
    ],
    "domain_rules": {"fail_action": {"map": [{"from": list(a), "to": b} for a, b in FAIL_MAP], "direct_map": [{"from": list(a), "to": b} for a, b in FAIL_DIRECT]}},
    "value_aliases": {
        "rating": [{"from": [f"CLASS {n}", f"CL {n}", f"ANSI {n}", f"{n} LB", f"{n}"], "to": f"{n}#"} for n in (150, 300, 600)],
        "fail_action": [{"from": ["OPEN"], "to": "FAIL OPEN", "compare_only": True}],
    },
    "model_to_manufacturer": {"enabled": True, "rules": [{"prefix": ["66", "65"], "to": "NORTHGATE", "kind": "actuator"}, {"prefix": ["667", "V1"], "to": "EASTVALE", "kind": "actuator"}]},
    "composite_labels": [{"label": "Size / Rating", "separator": "/", "fields": ["body_size", "rating"]}, {"label": "Model / Trim", "separator": "/", "fields": ["model", None]}],
    "format_rules": {"tag": {"tag": True, "max_length": 20}, "rated_cv": {"numeric": True, "max_length": 20}, "maker": {"max_length": 30}, "rating": {"numeric": True, "max_length": 12}},
    "sections": {"aliases": {"VALVE BODY": "body", "ACTUATOR": "actuator", "LINE": "none"}, "allowed": {"body": ["model", "rating", "body_size"], "actuator": ["fail_action"], "none": []}},
    "enum_allowed_values": {"enabled": True, "correct": ["rating"], "flag_only": {"maker": ["NORTHGATE", "EASTVALE"]}},
    "derived_fields": {"enabled": True, "type_name": {"from": "tag", "how": "tag_kind", "map": TAG_KINDS}},
    "unit_tokens": ["kg/cm2", "m3/h", "%", "mm", "bar"],
    "numeric_format": {"enabled": True, "leading_zero": True},
    "guidance": {},
}


def set_guidance(path: str, key: str, text: str | None, by: str = "", today: str = "") -> str | None:
    """Write a field's guidance to a YAML file, or remove it where the text is blank; returns what was there."""
    file = Path(path)
    doc = (yaml.safe_load(file.read_text(encoding="utf-8")) if file.exists() else None) or {}
    fields = dict(doc.get("fields") or {})
    before = fields.pop(key, None) or {}
    if text and text.strip():
        fields[key] = {"text": text.strip() + "\n"} | ({"by": by} if by else {}) | ({"updated": today} if today else {})
    file.write_text(yaml.safe_dump(doc | {"fields": fields}, allow_unicode=True, sort_keys=False), encoding="utf-8")
    return before.get("text")


@dataclass
class RuleSet:
    """Rules of one run; ``hashes`` tell which files they came from."""

    rules: dict = field(default_factory=lambda: DEFAULT)
    hashes: dict = field(default_factory=dict)
    label_rows: list | None = field(default=None, repr=False, compare=False)

    @classmethod
    def load(cls, fields: str, rules: str, guidance: str | None = None) -> RuleSet:
        """From YAML files; a missing guidance file is empty guidance."""
        read = lambda p: yaml.safe_load(Path(p).read_text(encoding="utf-8")) or {}
        merged = dict(read(rules))
        merged["fields"] = read(fields)["fields"]
        flags = merged.get("punct_significant") or []
        for f in merged["fields"]:
            f.setdefault("punctuation", f["key"] in flags)
        there = guidance and Path(guidance).exists()
        merged["guidance"] = read(guidance) if there else {}
        merged["sections"] = merged.get("sections") or {}
        sha = {Path(p).name: hashlib.sha256(Path(p).read_bytes()).hexdigest()[:12] for p in (fields, rules, *([guidance] if there else []))}
        return cls(merged, sha)

    def _table(self, spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(rows, schema))

    def fields(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f["key"], f["name"], bool(f.get("required")), f.get("safety", "normal"), f.get("source", "document"), bool(f.get("mvp")), float(f.get("threshold", 0.9)), bool(f.get("punctuation")), f.get("numeric")) for i, f in enumerate(self.rules["fields"])]
        return self._table(spark, rows, "ord int, field_key string, name string, required boolean, safety string, source string, mvp boolean, threshold double, punctuation boolean, numeric boolean")

    def fields_of(self, spark: SparkSession, kind: str) -> DataFrame:
        """The fields that are mvp or required, or that a person must see (human: safety and identity fields)."""
        return self.fields(spark).where({"mvp": "mvp", "required": "required", "human": "safety <> 'normal'"}[kind])

    def alias_index(self, spark: SparkSession, only_mvp: bool = False) -> DataFrame:
        """(norm, field_key) of names and aliases; of fields that share one, the first defined has it."""
        rows = [(i, str(a.get("label") if isinstance(a, dict) else a), f["key"]) for i, f in enumerate(self.rules["fields"]) if f.get("mvp") or not only_mvp for a in (f["name"], *(f.get("aliases") or []))]
        terms = self._table(spark, rows, "ord int, term string, field_key string")
        return F.broadcast(terms.groupBy(norm_label(F.col("term")).alias("norm")).agg(F.min_by("field_key", "ord").alias("field_key")))

    def labels(self, spark: SparkSession) -> DataFrame:
        """Names (confidence 1) before aliases (0.95), in field order; an alias may be {label, section}.

        An alias that begins with a section's name is also, without it, an
        alias within that section, where three characters or more are left.
        """
        rows, prefixes = [], {plain_label(a): s for a, s in self.section_names(by_alias=True).items()}
        for i, f in enumerate(self.rules["fields"]):
            rows.append((f["name"], f["key"], None, 1.0, "name", i * 1000))
            for k, a in enumerate(f.get("aliases") or []):
                label, section = (a.get("label"), a.get("section")) if isinstance(a, dict) else (a, None)
                rows.append((label, f["key"], section, 0.95, "alias", 1_000_000 + i * 1000 + k))
                norm = plain_label(label)
                rows += [(norm[len(p) :], f["key"], s, 0.95, "alias", 1_000_000 + i * 1000 + k) for p, s in prefixes.items() if p and norm.startswith(p) and len(norm) - len(p) >= 3]
        return self._table(spark, rows, "label string, field_key string, section string, confidence double, matched_on string, ord int")

    def aliases(self, spark: SparkSession) -> DataFrame:
        rows = [(key, raw, e["to"], bool(e.get("compare_only")), i) for key, entries in (self.rules.get("value_aliases") or {}).items() for i, e in enumerate(e for e in entries if e.get("to")) for raw in dict.fromkeys([*e.get("from", []), e["to"]])]
        return self._table(spark, rows, "field_key string, raw string, to string, compare_only boolean, ord int")

    def domain(self, spark: SparkSession) -> DataFrame:
        rows = [(key, kind, raw, m["to"], i) for key, block in (self.rules.get("domain_rules") or {}).items() for kind in ("map", "direct_map") for i, m in enumerate(block.get(kind) or []) for raw in m["from"]]
        return self._table(spark, rows, "field_key string, kind string, raw string, to string, ord int")

    def prefixes(self, spark: SparkSession) -> DataFrame:
        block = self.rules.get("model_to_manufacturer") or {}
        rows = [(r["kind"], p, r["to"], i) for i, r in enumerate(block.get("rules", []) if block.get("enabled", True) else []) for p in r["prefix"]]
        return self._table(spark, rows, "kind string, prefix string, to string, ord int")

    def formats(self, spark: SparkSession) -> DataFrame:
        rows = [(k, r.get("numeric"), r.get("tag"), r.get("pattern"), r.get("max_length")) for k, r in (self.rules.get("format_rules") or {}).items()]
        return self._table(spark, rows, "field_key string, need_number boolean, need_tag boolean, pattern string, max_length int")

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """Allowed values; those of correctable fields are the targets of their aliases."""
        block = self.rules.get("enum_allowed_values") or {}
        rows = []
        if block.get("enabled"):
            for key in block.get("correct") or []:
                rows += [(key, e["to"], True) for e in (self.rules.get("value_aliases") or {}).get(key, []) if e.get("to")]
            for key, values in (block.get("flag_only") or {}).items():
                rows += [(key, v, False) for v in values]
        return self._table(spark, rows, "field_key string, value string, correctable boolean")

    def composites(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, [(c["label"],) for c in self.composite_rules().values()], "label string")

    def composite_rules(self) -> dict[str, dict]:
        """Rules for labels of several fields by plain label; of entries with one label the last wins."""
        return {plain_label(c["label"]): c for c in self.rules.get("composite_labels") or []}

    def section_names(self, by_alias: bool = False):
        """The sections that aliases name, or the aliases with their sections."""
        aliases = (self.rules.get("sections") or {}).get("aliases") or {}
        return dict(aliases) if by_alias else [*dict.fromkeys(aliases.values())]

    def section_allowed(self) -> dict[str, list[str]]:
        block = self.rules.get("sections") or {}
        return {k: list(v or []) for k, v in (block.get("allowed") or block.get("fields") or {}).items()}

    def section_aliases(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, [*(self.rules["sections"].get("aliases") or {}).items()], "alias string, section string")

    def section_fields(self, spark: SparkSession) -> DataFrame:
        """A section without a row allows every field; an empty list allows none."""
        return self._table(spark, [*self.section_allowed().items()], "section string, allowed array<string>")

    def derived(self, spark: SparkSession) -> DataFrame:
        block = self.rules.get("derived_fields") or {}
        rows = [(key, d["from"], kind, value) for key, d in block.items() if isinstance(d, dict) and block.get("enabled", True) for kind, value in (d.get("map") or {}).items()]
        return self._table(spark, rows, "field_key string, source_key string, kind string, value string")

    def units(self) -> list[str]:
        return [str(u) for u in self.rules.get("unit_tokens") or []]

    def guidance(self, key: str | None = None) -> str | None:
        block = self.rules.get("guidance") or {}
        entry = (block.get("fields") or {}).get(key) if key else block.get("general")
        return entry.get("text") if entry else None
