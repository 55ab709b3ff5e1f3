"""Problem 7: values typed freely, mapped to the entries of a reference list.

Method: a BK-tree over the reference entries under Levenshtein distance, a true metric, broadcast (or,
beyond `SHARD` entries, cut into shards whose winners are merged, with the same result). All values of a batch go down the tree
together: at a node, one bit-parallel pass gives the distances of its entry to every value still there,
and the triangle inequality decides which values follow each edge. Entries within the radius come out
whole; a value means the nearest one, where a swap of neighbours counts as one slip.

Before that a value is brought to the forms it may stand for (decoration, order, short forms, initials),
and each form is looked up. Rules of the fields are fixed values below; lists of others need none.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import parallelism

#: Reference entries up to which the trees are broadcast whole.
SHARD = 20_000
#: Short and other forms of words, by field, in lower case.
WORDS = {
    "skill": {"test": "testing", "tests": "testing", "gov": "governance", "govern": "governance", "autom": "automation", "automating": "automation", "audit": "auditing", "audits": "auditing", "mdlg": "modeling", "models": "modeling", "model": "modeling", "modelling": "modeling", "vis": "visualization", "viz": "visualization", "visualisation": "visualization", "forecast": "forecasting", "forecasts": "forecasting", "fcst": "forecasting", "stats": "statistics", "stat": "statistics", "comm": "communication", "comms": "communication", "python3": "python", "phyton": "python", "xls": "excel", "psql": "sql"},
    "seniority": {"jr": "junior", "jnr": "junior", "entry": "junior", "debutant": "junior", "beginner": "junior", "intermediate": "mid", "intermed": "mid", "medior": "mid", "sr": "senior", "snr": "senior", "princ": "principal", "principle": "principal", "teamlead": "lead", "mgr": "manager", "dir": "director", "direktor": "director", "directeur": "director", "leiter": "manager"},
    "location": {"st": "saint", "ste": "saint", "sainte": "saint", "ft": "fort", "mt": "mount", "pt": "port"},
}
#: Words that say nothing of which entry is meant.
NOISE = {
    "skill": {"advanced", "basic", "basics", "experience", "skills", "skill", "language", "spreadsheets", "spreadsheet", "ms", "microsoft", "applied", "yrs", "years", "knowledge", "expert", "proficient", "good", "strong", "programming", "of", "data", "x", "the", "with", "in"},
    "seniority": {"level", "ic", "tech", "team", "people", "role", "position", "yrs", "years", "of", "the"},
    "location": {"greater", "metro", "area", "office", "on", "site", "hybrid", "days", "day", "the", "region"},
}
#: Words of a place worked from, and the words that tell how far away.
REMOTE = ("remote", "rmote", "wfh", "anywhere", "home", "télétravail", "teletravail")
REACH = (("national", ("national", "nationwide", "country")), ("continent", ("continent", "continental")), ("global", ("global", "worldwide", "world", "globe")))
_WORD = re.compile(r"[^\W_]+")


def plain(s: str) -> str:
    """Lower case without accents and marks."""
    s = unicodedata.normalize("NFKD", s.replace("™", "").replace("®", ""))
    return "".join(c for c in s if not unicodedata.combining(c)).lower().replace("ß", "ss")


def squash(s: str) -> str:
    return "".join(_WORD.findall(s))


def slips(a: str, b: str, most: int = 3) -> int:
    """Edit distance where a swap of neighbours counts once; `most` + 1 stands for anything above."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return min(row[-1], most + 1)


def levenshtein(a: str, b: str) -> int:
    """Edit distance of any two strings, bit-parallel over the first."""
    if not a:
        return len(b)
    eq: dict[str, int] = {}
    for i, c in enumerate(a):
        eq[c] = eq.get(c, 0) | 1 << i
    full, last, pv, mv, score = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, len(a)
    for c in b:
        e = eq.get(c, 0)
        xv, xh = e | mv, (((e & pv) + pv) ^ pv) | e
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh & full
        score += bool(ph & last) - bool(mh & last)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
    return score


class Words:
    """Strings as a padded matrix of character codes, for distances to one pattern at a time."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.size = np.array([len(t) for t in texts], np.int64)
        self.alphabet: dict[str, int] = {}
        wide = int(self.size.max()) if len(texts) else 0
        self.codes = np.zeros((wide, len(texts)), np.int32)
        for k, t in enumerate(texts):
            for i, c in enumerate(t):
                self.codes[i, k] = self.alphabet.setdefault(c, len(self.alphabet) + 1)

    def distances(self, pattern: str, which: np.ndarray) -> np.ndarray:
        """Levenshtein distances of `pattern` to the strings `which`; a long pattern goes string by string, in wide integers."""
        m = len(pattern)
        if m > 63:
            return np.array([levenshtein(pattern, self.texts[k]) for k in which.tolist()], np.int64)
        eq = np.zeros(len(self.alphabet) + 1, np.uint64)
        for i, c in enumerate(pattern):
            k = self.alphabet.get(c)
            if k:
                eq[k] |= np.uint64(1 << i)
        codes, size = self.codes[:, which], self.size[which]
        full, high, one = np.uint64((1 << m) - 1), np.uint64(m - 1), np.uint64(1)
        pv, mv = np.full(len(which), full), np.zeros(len(which), np.uint64)
        score = np.full(len(which), m, np.int64)
        for j in range(int(size.max()) if len(size) else 0):
            e = eq[codes[j]]
            xv = e | mv
            xh = (((e & pv) + pv) ^ pv) | e
            ph, mh = mv | (~(xh | pv) & full), pv & xh
            step = (ph >> high & one).astype(np.int64) - (mh >> high & one).astype(np.int64)
            live = j < size
            score += np.where(live, step, 0)
            ph, mh = (ph << one | one) & full, mh << one & full
            pv, mv = np.where(live, mh | (~(xv | ph) & full), pv), np.where(live, ph & xv, mv)
        return score


class BKTree:
    """Nodes are entries; the subtree on edge d of a node holds the entries at distance d from it."""

    def __init__(self, entries: list[str]):
        self.entries = list(dict.fromkeys(e for e in entries if e))
        self.edges: list[dict[int, int]] = []
        for k, e in enumerate(self.entries):
            self.edges.append({})
            at = 0
            while k:
                d = self.metric(e, self.entries[at])
                nxt = self.edges[at].get(d)
                if nxt is None:
                    self.edges[at][d] = k
                    break
                at = nxt

    @staticmethod
    @lru_cache(maxsize=1)
    def _one(text: str) -> Words:
        return Words([text])

    @classmethod
    def metric(cls, a: str, b: str) -> int:
        return int(cls._one(a).distances(b, np.zeros(1, np.int64))[0])

    def within(self, texts: list[str], radius: np.ndarray) -> list[list[tuple[int, int]]]:
        """Of each text, (distance, entry number) of every entry within its radius."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not self.entries or not texts:
            return out
        words = Words(texts)
        work = [(0, np.arange(len(texts)))]
        while work:
            node, which = work.pop()
            d = words.distances(self.entries[node], which)
            near = d <= radius[which]
            for k, x in zip(which[near].tolist(), d[near].tolist(), strict=True):
                out[k].append((x, node))
            for edge, child in self.edges[node].items():
                go = np.abs(d - edge) <= radius[which]  # the triangle inequality
                if go.any():
                    work.append((child, which[go]))
        return out


class Reference:
    """The entries of one field: their squashed forms, and the tree over these."""

    def __init__(self, field: str, entries: list[tuple[int, str]]):
        self.field = field
        self.exact: dict[str, int] = {}
        names: dict[str, int] = {}
        for i, name in sorted(entries):
            names.setdefault(squash(plain(name)), i)
            if field == "location":
                self._initials(plain(name), i)
        self.names = names
        self.tree = BKTree(list(names))
        self.ids = [names[e] for e in self.tree.entries]
        self.alias = {k: v for k, v in self.exact.items() if k not in names and v != -1}
        self.initials = BKTree(list(self.alias))
        self.longest = max(map(len, [*names, *self.alias]), default=0)
        self.remote = {r: i for i, n in sorted(entries, reverse=True) for r, _ in REACH if "remote" in plain(n) and r in plain(n)}

    @staticmethod
    def initials_key(name: str) -> str | None:
        """A plain name with its first word as an initial; None for a single word."""
        head, _, town = name.rpartition("—")
        parts = town.split()
        return squash(head) + parts[0][0] + squash(" ".join(parts[1:])) if len(parts) > 1 else None

    def _initials(self, name: str, i: int) -> None:
        key = self.initials_key(name)
        if key:
            self.exact[key] = i if self.exact.get(key, i) == i else -1

    def forms(self, value: str) -> list[str]:
        """Squashed forms the value may stand for, likeliest first."""
        s = plain(value).strip()
        words, noise = WORDS.get(self.field, {}), NOISE.get(self.field, set())
        out = [squash(s)]

        def add(t: str, prefix: str = "") -> None:
            w = [x for x in _WORD.findall(t.replace("'", ""))]
            out.append(prefix + "".join(w))
            kept = [words.get(x, x) for x in w]
            bare = [x for x in kept if x not in noise and not x.isdigit()]
            out.append(prefix + "".join(kept))
            if bare:
                out.append(prefix + "".join(bare))

        def shapes(t: str, prefix: str = "") -> None:
            add(t, prefix)
            outer = re.sub(r"\([^()]*\)", " ", t)
            if outer.strip():
                add(outer, prefix)
                t = outer
            short = re.sub(r"[\s-]+v?\d+(\.[\dx]+)*\s*$", "", t)
            if short != t:
                add(short, prefix)
            if m := re.fullmatch(r"\s*(\w+) of (.+?)(?: data)?\s*", t):
                add(f"{m[2]} {m[1]}", prefix)
            for sep in (",", "/", " - "):
                head, found, tail = t.partition(sep)
                if found:
                    add(f"{tail} {head}", prefix)
                    head2 = t.rpartition(sep)[0]
                    for h in {head, head2} - {""}:
                        add(h, prefix)
                        a, more, b = h.partition(",")
                        if more:
                            add(f"{b} {a}", prefix)
            if re.search(r"\d|\.", t):
                add(re.sub(r"[\d.]+", "", t), prefix)

        shapes(s)
        if self.field == "location" and "hybrid" in s:
            rest = re.sub(r"\W*\bhybrid\b(?:\s*\d+\s*days?)?[\s:—–/-]*", " ", s).strip(" ,-/()")
            out = [out[0]]
            shapes(rest, "hybrid")
        return [x for x in dict.fromkeys(out) if x]

    def reach(self, value: str) -> int | None:
        s = plain(value)
        if not self.remote or not any(r in s for r in REMOTE):
            return None
        for name, keys in REACH:
            if any(k in s for k in keys) and name in self.remote:
                return self.remote[name]
        return None

    @staticmethod
    def radius(n: int) -> int:
        return 0 if n <= 2 else 1 if n <= 11 else 2

    def resolve(self, values: list[str]) -> list[tuple[int, tuple[int, int, int]]]:
        """(entry id or -1, rank) of each value. Ranks of parts of a list compare: the least is the whole list's.

        First comes an exact hit of the likeliest form, then the fewest slips, of a longer form, then slips of initials.
        """
        out: list[tuple[tuple[int, int, int], int]] = []
        open_, forms = [], []
        for k, v in enumerate(values):
            hit = self.reach(v) if self.field == "location" else None
            if hit is not None:
                out.append(((0, -1, 0), hit))
                continue
            own = self.forms(v)
            found = next(((n, i) for n, f in enumerate(own) if (i := self.names.get(f, self.alias.get(f))) is not None), None)
            out.append(((0, found[0], 0), found[1]) if found else (NONE, -1))
            if not found:
                for f in own:
                    if 2 < len(f) <= self.longest + 4:  # a longer one has no entry within reach
                        open_.append(k)
                        forms.append(f)
        limit = np.array([self.radius(len(f)) for f in forms], np.int64)
        # A slip that is a swap costs two edits.
        for kind, tree, ids, most, takes in ((1, self.tree, self.ids, limit, lambda f, a: True), (2, self.initials, list(self.alias.values()), np.array([int(len(f) > 6) for f in forms], np.int64), lambda f, a: a[0] == f[0])):
            for k, f, reach, near in zip(open_, forms, most.tolist(), tree.within(forms, 2 * most), strict=True):
                for _, node in near:
                    entry = tree.entries[node]
                    if takes(f, entry) and (d := slips(f, entry, reach)) <= reach:
                        out[k] = min(out[k], ((kind, d, -len(f) if kind == 1 else 0), ids[node]))
        return [(i, rank) for rank, i in out]


@lru_cache(maxsize=8)
def _reference(field: str, entries: tuple[tuple[int, str], ...]) -> Reference:
    """A worker's tree of a field, built once for all its tasks."""
    return Reference(field, list(entries))


#: Rank of a value that means no entry.
NONE = (9, 0, 0)
_SCHEMA = "field string, value string, r0 int, r1 int, r2 int, ref_id long"


def _resolved(field: str, part: list[str], reference: Reference | None) -> pd.DataFrame:
    got = reference.resolve(part) if reference else [(-1, NONE)] * len(part)
    return pd.DataFrame({"field": field, "value": part, **{f"r{k}": [g[1][k] for g in got] for k in range(3)}, "ref_id": [g[0] for g in got]})


def _shard_key(batches):
    """Entries with the name by which they are put into shards, so that all that one's initials depend on come together."""
    for pdf in batches:
        flat = [plain(n) for n in pdf["name"]]
        yield pdf.assign(key=[(Reference.initials_key(n) if f == "location" else None) or squash(n) for f, n in zip(pdf["field"], flat, strict=True)])


def resolve_values(values: DataFrame, reference: DataFrame, shard: int = SHARD) -> DataFrame:
    """(field, value, ref_id) of distinct (field, value); ref_id -1 where none is meant.

    Up to `shard` entries, all fields together, the trees are broadcast. A longer list is cut into shards,
    each a task's tree; every value goes to all shards of its field, and the least rank wins, so the result
    is the same.
    """
    spark = values.sparkSession
    named = reference.where("name is not null and field is not null").select("field", "ref_id", "name")
    counts = {r["field"]: r["n"] for r in named.groupBy("field").agg(F.count("*").alias("n")).collect()}
    if sum(counts.values()) <= shard:
        entries: dict[str, list[tuple[int, str]]] = {}
        for r in named.collect():
            entries.setdefault(r["field"], []).append((r["ref_id"], r["name"]))

        whole = {f: tuple(v) for f, v in entries.items()}

        def run(batches):
            for pdf in batches:
                for field, own in pdf.groupby("field", sort=False):
                    for lo in range(0, len(own), 5000):
                        yield _resolved(field, own["value"].iloc[lo : lo + 5000].tolist(), _reference(field, whole[field]) if field in whole else None)

        return values.repartition(parallelism(spark), "value").mapInPandas(run, _SCHEMA).select("field", "value", "ref_id")
    shards = F.create_map(*[x for f, n in counts.items() for x in (F.lit(f), F.lit(max(1, -(-n // shard))))])
    right = named.mapInPandas(_shard_key, "field string, ref_id long, name string, key string").withColumn("shard", F.pmod(F.xxhash64("key"), shards[F.col("field")]).cast("int"))
    left = values.withColumn("shard", F.explode(F.sequence(F.lit(0), F.coalesce(shards[F.col("field")] - 1, F.lit(0)))))
    cell = F.pmod(F.xxhash64("value"), F.lit(parallelism(spark))).cast("int")
    both = right.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(parallelism(spark) - 1)))).select("field", "shard", "cell", F.col("name").alias("text"), "ref_id")
    both = both.unionAll(left.select("field", "shard", cell, F.col("value"), F.lit(None).cast("long")))

    def one(batches):
        """Rows sorted by field, shard and cell, the entries first: the tree, then values as they come."""
        key, entries, tree = None, [], None
        for pdf in batches:
            for k, own in pdf.groupby(["field", "shard", "cell"], sort=False):
                if k != key:
                    key, entries, tree = k, [], None
                refs, vals = own[own["ref_id"].notna()], own[own["ref_id"].isna()]
                entries += zip(refs["ref_id"].astype(int).tolist(), refs["text"], strict=True)
                if len(vals):
                    tree = tree or Reference(k[0], entries)
                    for lo in range(0, len(vals), 5000):
                        yield _resolved(k[0], vals["text"].iloc[lo : lo + 5000].tolist(), tree)

    won = both.repartition(parallelism(spark), "field", "shard", "cell").sortWithinPartitions("field", "shard", "cell", F.col("ref_id").isNull()).mapInPandas(one, _SCHEMA)
    return won.groupBy("field", "value").agg(F.min(F.struct("r0", "r1", "r2", "ref_id")).alias("m")).select("field", "value", F.col("m.ref_id").alias("ref_id"))


def map_postings(postings: DataFrame, reference: DataFrame, shard: int = SHARD) -> DataFrame:
    """(posting_id, field, pos, ref_id) of every value that isn't, letter for letter, an entry of its field.

    Null and blank values are no cases, nor are values that are entries. Repeated elements of a list come
    out once per position, repeated rows once. An empty reference list gives -1 everywhere; an empty
    table gives no rows. Blank means spaces and control characters only.
    """
    one = lambda f, c: F.struct(F.lit(f).alias("field"), F.lit(0).alias("pos"), F.col(c).alias("value"))
    skills = F.transform(F.coalesce(F.col("top_skills"), F.array().cast("array<string>")), lambda x, i: F.struct(F.lit("skill").alias("field"), (i + 1).alias("pos"), x.alias("value")))
    rows = postings.where("id is not null").select(F.col("id").alias("posting_id"), F.explode(F.concat(F.array(one("location", "canonical_location"), one("seniority", "seniority_band")), skills)).alias("v")).select("posting_id", "v.*").where("value is not null and value rlike '\\\\S'")
    known = reference.select("field", F.col("name").alias("value")).distinct()
    rows = rows.join(known, ["field", "value"], "left_anti")
    values = rows.select("field", "value").distinct()
    return rows.join(resolve_values(values, reference, shard), ["field", "value"]).select("posting_id", "field", "pos", "ref_id").distinct()
