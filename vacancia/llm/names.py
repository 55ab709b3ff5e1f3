"""Problem 5: variant spellings of organisations' names.

Method: suffix blocking. A name is read as its proper words, its line of business and its legal form.
The suffixes of the proper words, from `MIN_SUFFIX` letters up, are indexed. A suffix held by more forms
than `COMMON` is first refined with the line of business, then with the initial of another word, and is
given up only if it is still that common; every form also has its whole words as suffixes, refined by
line and first letters, so names that share a word always meet. Pairs that meet are compared by the
ratio of their longest common subsequence, word order and joined words aside.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut, parallelism
from .graph import components

#: Shortest indexed suffix, forms at a block before it is refined, least common-subsequence ratio.
MIN_SUFFIX, COMMON, RATIO = 4, 60, 0.85
#: Words of legal forms, of lines of business, and short forms of first names.
LEGAL = {"inc", "incorporated", "corp", "corporation", "ltd", "limited", "gmbh", "company", "co", "llc", "plc", "ag", "sa", "sarl", "llp", "the", "and"}
LINES = ("health", "services", "media", "group", "manufacturing", "robotics", "analytics", "engineering", "systems", "logistics", "financial", "insurance", "laboratories", "consulting", "energy", "technologies", "foods", "staffing")
NICKNAMES = {
    "alexander": ("alex", "sandy", "xander", "al"), "elizabeth": ("liz", "beth", "eliza", "betty", "lizzie", "libby"), "frederick": ("fred", "freddie", "freddy", "rick"),
    "josephine": ("jo", "josie", "joey"), "katherine": ("kate", "katie", "kathy", "kat", "kitty"), "margaret": ("maggie", "peggy", "meg", "marge", "greta"),
    "michael": ("mike", "mick", "mickey", "micky"), "robert": ("rob", "bob", "bobby", "robbie", "bert"), "theodore": ("ted", "theo", "teddy"), "william": ("bill", "will", "billy", "liam", "willy"),
}
_FORMAL = {n: k for k, v in NICKNAMES.items() for n in v} | {k: k for k in NICKNAMES}
_JOINED = re.compile(r"\b([A-Z][a-z]{2,})([A-Z][a-z]{2,})\b")


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def _short_for(t: str, word: str) -> bool:
    if t == word:
        return True
    if len(t) < 2 or t[0] != word[0]:
        return False
    if len(t) >= 5 and abs(len(t) - len(word)) <= 1 and ratio(t, word) > 0.85:
        return True
    if len(t) > len(word) - 1:
        return False
    if word.startswith(t) and len(t) >= 3:
        return True
    it = iter(word)
    return all(c in it for c in t) and not any(c in "aeiou" for c in t[1:] if len(t) <= 3) and (sum(c in "aeiou" for c in t) < sum(c in "aeiou" for c in word))


@lru_cache(maxsize=200_000)
def _line_word(t: str) -> str | None:
    if t in ("labs", "eng", "engrg", "fin", "finl", "ins", "sys", "tech", "mfg"):
        return {"labs": "laboratories", "eng": "engineering", "engrg": "engineering", "fin": "financial", "finl": "financial", "ins": "insurance", "sys": "systems", "tech": "technologies", "mfg": "manufacturing"}[t]
    hits = [w for w in LINES if _short_for(t, w)]
    return min(hits, key=lambda w: (w != t, -ratio(t, w))) if hits else None


def parse(name: str) -> tuple[list[str], str]:
    """Proper words, sorted (first names in full), and the line of business ('' if none is said)."""
    s = unicodedata.normalize("NFKC", name).replace("'", "").replace("’", "")
    s = re.sub(r"\b((?:[A-Za-z]\.){2,})", lambda m: m.group(1).replace(".", "") + " ", _plain(s))
    s = _JOINED.sub(lambda m: m.group(0) if m.group(0).lower() in LEGAL else f"{m.group(1)} {m.group(2)}", s)
    inner = [x for b in re.findall(r"\(([^)]*)\)", s) for x in re.findall(r"[a-z]+", b.lower())]
    words = re.findall(r"[a-z0-9]+", re.sub(r"\([^)]*\)", " ", s).lower())
    words += [x for x in inner if _line_word(x)]
    for k in range(len(words) - 1):  # g m b h, written apart
        if words[k : k + 4] == ["g", "m", "b", "h"] or words[k : k + 2] == ["gm", "bh"]:
            words[k : k + (4 if words[k] == "g" else 2)] = ["gmbh"]
    line, proper, loose = [], [], []
    for w in words:
        if w in LEGAL or len(w) >= 5 and any(len(x) >= 5 and abs(len(x) - len(w)) <= 1 and ratio(x, w) > 0.85 for x in LEGAL):
            continue
        k = _line_word(w) if len(w) > 1 and w not in _FORMAL else None
        (line if k else proper).append(k or _FORMAL.get(w, w))
        if k and k != w:
            loose.append((w, k))
    if "staffing" in line:
        line = ["staffing"]
    elif len(set(line)) > 1 and set(line) not in ({"health", "services"}, {"media", "group"}):
        for w, k in loose:  # a word of the name itself that looks like a line's short form
            if len(set(line)) > 1 and k in line and len(line) - line.count(k) > 0:
                line.remove(k)
                proper.append(w)
    if not proper:
        proper, line = line, []
    return sorted(proper), " ".join(sorted(set(line)))


def same_words(a: list[str], b: list[str], least: float = RATIO) -> bool:
    """Whether two lists of proper words are spellings of one name."""
    a, b = list(a), list(b)
    if "".join(a) == "".join(b):
        return True
    for w in list(a):  # words they share take no part
        if w in b:
            a.remove(w)
            b.remove(w)
    shared = not a or not b
    if shared:
        return not a and not b
    for x, y in ((a, b), (b, a)):  # initials
        for w in [w for w in x if len(w) == 1]:
            full = next((v for v in y if v[0] == w), None)
            if full:
                x.remove(w)
                y.remove(full)
    if not a and not b:
        return True
    if not a or not b:
        return False
    if len(a) == len(b):
        rest = list(b)
        for w in a:
            best = max(rest, key=lambda v: ratio(w, v))
            if ratio(w, best) < min(least, 1 - 2.2 / (len(w) + len(best))) or abs(len(w) - len(best)) > 2:
                break
            rest.remove(best)
        else:
            return True
        if any(w in NICKNAMES for w in a) != any(w in NICKNAMES for w in b) and len(a) == 1:
            return False
    x, y = "".join(a), ["".join(b)]
    if len(b) == 2:
        y.append(b[1] + b[0])
    xs = [x] + ([a[1] + a[0]] if len(a) == 2 else [])
    return len(a) != len(b) and any(ratio(p, q) >= max(least, 0.9) for p in xs for q in y)


def blocks(words: list[str], line: str) -> list[tuple[str, str, str]]:
    """(suffix, line, initials of the other words) of a form."""
    out = set()
    for k, w in enumerate(words):
        rest = "".join(v[0] for i, v in enumerate(words) if i != k)[:1]
        if 1 < len(w) < MIN_SUFFIX:  # a short word is indexed whole
            out.add((w, line, rest))
        for i in range(0, max(1, len(w) - MIN_SUFFIX + 1)):
            if len(w) - i >= MIN_SUFFIX:
                out.add((w[i:], line, rest))
    return sorted(out)


def _parse_all(batches):
    for pdf in batches:
        got = [parse(n) for n in pdf["name"]]
        yield pd.DataFrame({"name": pdf["name"], "seen": pdf["seen"], "words": [g[0] for g in got], "line": [g[1] for g in got]})


def _index(batches):
    for pdf in batches:
        rows = [(f, w, ln, n, *k) for f, w, ln, n in zip(pdf["form"], pdf["words"], pdf["line"], pdf["n"], strict=True) for k in blocks(list(w), ln)]
        yield pd.DataFrame(rows, columns=["form", "words", "line", "n", "suffix", "l", "rest"])


def _links():
    def run(batches):
        """Rows sorted by block, the most frequent form first: links between a form and the earlier ones of its
        block that it equals. Those that earlier links have joined are one cluster, which is met once."""
        key, forms, out = None, [], []
        root: list[int] = []

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for pdf in batches:
            for k, form, words, line in zip(pdf["block"], pdf["form"], pdf["words"], pdf["line"], strict=True):
                if k != key:
                    key, forms, root = k, [], []
                words, own = list(words), len(forms)
                met = set()
                forms.append((form, words, line))
                root.append(own)
                for i, (f, w, ln) in enumerate(forms[:-1]):
                    if (ln == line or not ln or not line) and top(i) not in met and same_words(words, w):
                        out.append((f, form, bool(ln) == bool(line)))
                        met.add(top(i))
                        if ln == line:
                            root[top(own)] = top(i)
                            met.add(top(i))
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "strong"])
                out = []

    return run


def name_clusters(names: DataFrame, column: str = "name", common: int = COMMON) -> DataFrame:
    """(name, firm) of every distinct name; firm is a number that variants of one name share.

    Nulls and blank names, and names without any word of their own, are left out. Repeated rows count
    once. An empty table gives no rows.
    """
    spark = names.sparkSession
    rows = names.select(F.col(f"`{column}`").alias("name")).where("name is not null and name rlike '\\\\S'").groupBy("name").agg(F.count("*").alias("seen"))
    parsed = cut(rows.mapInPandas(_parse_all, "name string, seen long, words array<string>, line string").where("size(words) > 0").withColumn("form", F.xxhash64("words", "line")))
    forms = parsed.groupBy("form").agg(F.first("words").alias("words"), F.first("line").alias("line"), F.sum("seen").alias("n"))
    indexed = cut(forms.mapInPandas(_index, "form long, words array<string>, line string, n long, suffix string, l string, rest string"))
    size = lambda *by: indexed.groupBy(*by).agg(F.countDistinct("form").alias("c")).where(F.col("c") > common)
    wide = size("suffix").withColumnRenamed("c", "c1")
    wider = size("suffix", "l").withColumnRenamed("c", "c2")
    widest = size("suffix", "l", "rest").withColumnRenamed("c", "c3")
    placed = indexed.join(wide, "suffix", "left").join(wider, ["suffix", "l"], "left").join(widest, ["suffix", "l", "rest"], "left")
    whole = F.array_contains("words", F.col("suffix"))
    block = F.when(F.col("c1").isNull(), F.col("suffix")).when(F.col("c2").isNull(), F.concat_ws("|", "suffix", "l")).when(F.col("c3").isNull() | whole, F.concat_ws("|", "suffix", "l", "rest"))
    placed = placed.select(block.alias("block"), "form", "words", "line", "n").where("block is not null")
    met = placed.repartition(parallelism(spark), "block").sortWithinPartitions("block", F.expr("line = ''"), F.desc("n"), "form").mapInPandas(_links(), "a long, b long, strong boolean")
    met = cut(met.groupBy("a", "b").agg(F.max("strong").alias("strong")))
    joined = components(met.where("strong"), "a", "b")
    firm = forms.select("form", "line", "words").join(joined.withColumnRenamed("node", "form"), "form", "left").select("form", "line", "words", F.coalesce("component", "form").alias("firm"))
    # A name that says no line of business belongs to a firm only if it fits no other.
    loose = met.where("not strong").select("a", "b").unionAll(met.where("not strong").select(F.col("b").alias("a"), F.col("a").alias("b")))
    bare = firm.where("line = ''").select(F.col("form").alias("a"), F.col("firm").alias("bare"))
    full = firm.where("line != ''").select(F.col("form").alias("b"), F.col("firm").alias("to"))
    only = loose.join(bare, "a").join(full, "b").groupBy("bare").agg(F.min("to").alias("lo"), F.max("to").alias("hi")).where("lo = hi").select(F.col("bare").alias("firm"), "lo")
    firm = firm.join(only, "firm", "left").select("form", F.coalesce("lo", "firm").alias("firm"))
    return parsed.select("name", "form").join(firm, "form").select("name", "firm")


def name_links(postings: DataFrame, parsed: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: different spellings of one firm in the two tables."""
    names = postings.select(F.col("canonical_company").alias("name")).unionAll(parsed.select(F.col("company").alias("name")))
    names = names.where("name is not null and lower(trim(name)) != 'confidential'")
    own = cut(name_clusters(names))
    return own.select(F.col("name").alias("name_a"), "firm").join(own.select(F.col("name").alias("name_b"), "firm"), "firm").where("name_a < name_b").select("name_a", "name_b")
