"""Tiered rules over a title and a company, as one native expression (FLT-01, 02, 03)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Rule:
    pattern: str
    kind: str = "substring"
    note: str | None = None


#: Order of the tiers; the first of them with a match decides.
TIERS = ("pre_deny", "deny_company", "allow", "deny")


def matches(rule: Rule, c: Column) -> Column:
    """A regex is searched without regard to case; a substring is looked for in lower case."""
    hit = c.rlike("(?i)" + rule.pattern) if rule.kind == "regex" else F.lower(c).contains(rule.pattern.lower())
    return F.coalesce(hit, F.lit(False))


def first_match(rules: list[Rule], c: Column) -> Column:
    """The number of the first rule that matches, or NULL."""
    out = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(rules))):
        out = F.when(matches(r, c), k).otherwise(out)
    return out


#: Entities of titles in e-mails and pages.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&nbsp;": " ", "&#160;": " ", "&ndash;": "–", "&mdash;": "—", "&eacute;": "é", "&egrave;": "è", "&uuml;": "ü", "&ouml;": "ö", "&auml;": "ä", "&#38;": "&", "&amp;": "&"}


def decoded(c: Column) -> Column:
    """A text with its entities as characters; the ampersand last, so that nothing is decoded twice (FLT-01)."""
    for k, v in ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def load_rules(path: str) -> dict[str, list[Rule]]:
    """Rules by tier from a YAML or JSON file: a list of patterns per tier, each a text or a map of pattern, kind and note (SRC-12).

    A missing file is an error, as without rules everything would pass; an unknown tier or kind is one too.
    """
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        import yaml

        raw = yaml.safe_load(text)
    out: dict[str, list[Rule]] = {t: [] for t in TIERS}
    for tier, rules in (raw or {}).items():
        if tier not in out:
            raise ValueError(f"unknown tier {tier!r}")
        for r in rules or []:
            rule = Rule(r) if isinstance(r, str) else Rule(r["pattern"], r.get("kind", "substring"), r.get("note"))
            if rule.kind not in ("substring", "regex"):
                raise ValueError(f"unknown kind {rule.kind!r}")
            out[tier].append(rule)
    return out


def decide(rules: dict[str, list[Rule]], title: Column, company: Column) -> Column:
    """struct(action pass|drop, tier, reason). A blank title passes; a blank company can't be denied.

    Tier by tier: pre_deny (title) drops, deny_company (company) drops, allow (title) passes, deny
    (title) drops; anything else passes. The reason is the first matching rule's note, else its pattern.
    """
    title = decoded(title)
    out = F.struct(F.lit("pass").alias("action"), F.lit("none").alias("tier"), F.lit(None).cast("string").alias("reason"))
    for tier in reversed(TIERS):
        own = rules.get(tier, [])
        if not own:
            continue
        k = first_match(own, company if tier == "deny_company" else title)
        notes = F.array(*[F.lit(r.note or r.pattern) for r in own])
        hit = F.struct(F.lit("pass" if tier == "allow" else "drop").alias("action"), F.lit(tier).alias("tier"), F.get(notes, k).alias("reason"))
        out = F.when(k.isNotNull(), hit).otherwise(out)
    blank = F.struct(F.lit("pass").alias("action"), F.lit("blank").alias("tier"), F.lit("empty title").alias("reason"))
    return F.when(F.coalesce(F.trim(title), F.lit("")) == "", blank).otherwise(out)
