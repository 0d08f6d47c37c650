"""Text analysis as column expressions: the tokenizer of index and queries.

Everything but NFKC runs in the JVM. NFKC has no built-in: texts that hold a character it may change go through one
Arrow-batched function, all others stay where they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover import lexicons

LINK = r"(?:https?://|www\.)\S+"
#: Scripts whose runs become bigrams, and the Extended_Pictographic property.
CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}"
PICTURES = (
    r"\x{a9}\x{ae}\x{203c}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21a9}-\x{21aa}\x{231a}-\x{231b}\x{2328}\x{2388}\x{23cf}"
    r"\x{23e9}-\x{23f3}\x{23f8}-\x{23fa}\x{24c2}\x{25aa}-\x{25ab}\x{25b6}\x{25c0}\x{25fb}-\x{25fe}\x{2600}-\x{2605}"
    r"\x{2607}-\x{2612}\x{2614}-\x{2685}\x{2690}-\x{2705}\x{2708}-\x{2712}\x{2714}\x{2716}\x{271d}\x{2721}\x{2728}"
    r"\x{2733}-\x{2734}\x{2744}\x{2747}\x{274c}\x{274e}\x{2753}-\x{2755}\x{2757}\x{2763}-\x{2767}\x{2795}-\x{2797}\x{27a1}"
    r"\x{27b0}\x{27bf}\x{2934}-\x{2935}\x{2b05}-\x{2b07}\x{2b1b}-\x{2b1c}\x{2b50}\x{2b55}\x{3030}\x{303d}\x{3297}\x{3299}"
    r"\x{1f000}-\x{1f0ff}\x{1f10d}-\x{1f10f}\x{1f12f}\x{1f16c}-\x{1f171}\x{1f17e}-\x{1f17f}\x{1f18e}\x{1f191}-\x{1f19a}"
    r"\x{1f1ad}-\x{1f1e5}\x{1f201}-\x{1f20f}\x{1f21a}\x{1f22f}\x{1f232}-\x{1f23a}\x{1f23c}-\x{1f23f}\x{1f249}-\x{1f3fa}"
    r"\x{1f400}-\x{1f53d}\x{1f546}-\x{1f64f}\x{1f680}-\x{1f6ff}\x{1f774}-\x{1f77f}\x{1f7d5}-\x{1f7ff}\x{1f80c}-\x{1f80f}"
    r"\x{1f848}-\x{1f84f}\x{1f85a}-\x{1f85f}\x{1f888}-\x{1f88f}\x{1f8ae}-\x{1f8ff}\x{1f90c}-\x{1f93a}\x{1f93c}-\x{1f945}"
    r"\x{1f947}-\x{1faff}\x{1fc00}-\x{1fffd}"
)
#: A word character that is no CJK: "not (no letter, or CJK)", which every regex dialect can say.
_W = rf"(?:[^\P{{L}}{CJK}]|[\p{{N}}_])"
WORD = rf"{_W}+(?:['’]{_W}+)*"
PIECE = rf"[#@$]?{WORD}|[{CJK}]+|[{PICTURES}]+"
#: Characters NFKC leaves alone, or turns into something that separates words just as they do.
_STABLE = (
    r"\x{0}-\x{a9}\x{ab}-\x{b1}\x{b4}\x{b6}-\x{b7}\x{bb}\x{bf}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}"
    r"\x{386}\x{388}-\x{3ce}\x{400}-\x{45f}\x{2010}-\x{2016}\x{2018}-\x{201f}\x{2020}-\x{2022}\x{2026}\x{20ac}\x{3001}-\x{3002}\x{300c}-\x{300f}"
    r"\x{3041}-\x{3096}\x{30a1}-\x{30fc}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}\x{1f300}-\x{1faff}\x{fe0f}\x{200d}"
)
BIGRAM = "\x02"


def nfkc(text: Column) -> Column:
    """NFKC of a text; only texts that may change leave the JVM."""

    def normalise(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    may_change = F.when(text.rlike(f"[^{_STABLE}]"), text)
    return F.coalesce(F.pandas_udf(normalise, "string")(may_change), text)


def folded(text: Column) -> Column:
    """NFKC, lower case."""
    return F.lower(nfkc(text))


def pieces(folded_text: Column) -> Column:
    """Links out, then the runs the tokenizer works on."""
    return F.regexp_extract_all(F.regexp_replace(folded_text, LINK, " "), F.lit(f"({PIECE})"), F.lit(1))


def expand(runs: Column) -> Column:
    """Tokens of the runs, stopwords kept: prefix duals, CJK bigrams, one token per distinct picture."""

    def each(p: Column) -> Column:
        first, rest = F.substring(p, 1, 1), F.regexp_replace(F.substring(p, 2, 1 << 30), "’", "'")
        dual = F.when((first == "$") & rest.rlike(r"\A\p{N}+\z"), F.array(rest)).otherwise(F.array(F.concat(first, rest), rest))
        pair = F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(2)))
        return (
            F.when(first.isin("#", "@", "$"), dual)
            .when(first.rlike(f"[{CJK}]"), pair)
            .when(first.rlike(f"[{PICTURES}]"), F.array_distinct(F.split(p, "")))
            .otherwise(F.array(F.regexp_replace(p, "’", "'")))
        )

    return F.flatten(F.transform(runs, each))


def without_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(lexicons.stopwords()))


ANALYSIS = "tokens_all array<string>, tokens array<string>, present array<string>, tf array<long>, has_link boolean"


def tokenized(rows: DataFrame, text: str = "text", lexicon: dict | None = None) -> DataFrame:
    """``rows`` plus tokens_all, tokens (stopwords dropped), present (the distinct index terms: words, pairs, aspects) with their tf, has_link.

    One Arrow-batched pass per text: as higher-order column expressions (``pieces``, ``expand``, ``adjacent_bigrams``,
    ``aspect_tags``, equal in result) the same work takes several times the CPU, and filters pushed below them repeat it.
    """
    lexicon = lexicon or lexicons.aspects()

    def analyse(texts: pd.Series) -> pd.DataFrame:
        stop, out = frozenset(lexicons.stopwords()), []
        triggers = aspect_triggers(lexicon)
        for t in texts:
            every, link = tokens_and_link(t or "")
            kept = [x for x in every if x not in stop]
            pairs = [f"{BIGRAM}{x}{BIGRAM}{y}" for x, y in zip(kept, kept[1:], strict=False)]
            tags = aspects_of(kept, t or "", lexicon) if "$" in (t or "") or not triggers.isdisjoint(kept) else []
            counts = Counter(kept)
            counts.update(pairs)
            counts.update(tags)
            out.append((every, kept, list(counts), list(counts.values()), link))
        return pd.DataFrame(out, columns=["tokens_all", "tokens", "present", "tf", "has_link"])

    out = rows.withColumn("_a", F.pandas_udf(analyse, ANALYSIS)(F.col(text)))
    return out.select(*[F.col(c) for c in rows.columns], "_a.*")


def exploded(rows: DataFrame, items: Column, *keep, name: str = "term") -> DataFrame:
    """``keep`` and one row per item. Outer explode with a filter after it: a plain explode makes the optimizer test the
    array's size first, far below, and so compute it twice."""
    return rows.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def adjacent_bigrams(tokens: Column) -> Column:
    """Neighbouring pairs of the stopword-free stream as index terms; pairs and aspects don't pair again."""
    plain = lambda t: ~t.startswith(BIGRAM) & ~t.startswith("~")
    pairs = F.zip_with(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.when(plain(a) & plain(b), F.concat(F.lit(BIGRAM), a, F.lit(BIGRAM), b)),
    )
    return F.array_compact(pairs)


def aspect_tags(tokens: Column, raw: Column, lexicon: dict | None = None) -> Column:
    """Sorted aspects of a token stream: strong patterns always, weak words beside another content token."""
    padded = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    found = []
    for name, patterns in (lexicon or lexicons.aspects()).items():
        one = lambda ps: [p for p in ps if " " not in p]
        many = lambda ps: [p for p in ps if " " in p]

        def hit(ps: list[str]) -> Column:
            any_of = F.arrays_overlap(tokens, F.array(*[F.lit(p) for p in one(ps)])) if one(ps) else F.lit(False)
            for p in many(ps):
                any_of = any_of | F.contains(padded, F.lit(f" {p} "))
            return any_of

        weak = patterns["weak"]
        beside = F.exists(tokens, _content(weak))
        is_it = hit(patterns["strong"]) | (hit(weak) & beside)
        if name == "~price":
            is_it = is_it | raw.rlike(r"\$[0-9]")
        found.append(F.when(F.coalesce(is_it, F.lit(False)), F.lit(name)))
    return F.array_sort(F.array_compact(F.array(*found)))


def _content(weak: list[str]):
    return lambda t: ~t.startswith("~") & ~t.isin(weak)


def has_phrase(tokens_all: Column, phrase: list[str]) -> Column:
    """The words stand next to each other, stopwords counted."""
    wanted = F.array(*[F.lit(w) for w in phrase])
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens_all) - len(phrase) + 1, F.lit(1)))
    return F.exists(starts, lambda i: F.slice(tokens_all, i, F.lit(len(phrase))) == wanted)


def highlighted(text: Column, terms: list[str], mark: tuple[str, str] = ("[", "]")) -> Column:
    """The text with every whole-word occurrence of the terms marked; longer terms first, case ignored."""
    words = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}])({words})(?![\p{{L}}\p{{N}}])", f"{mark[0]}$1{mark[1]}") if words else text


# ---- the same tokenizer for one string (query side)
def _for_re(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)


_RE_CJK = re.compile(f"[{_for_re(CJK)}]")
_RE_PICTURES = re.compile(f"[{_for_re(PICTURES)}]")
_PLAIN = r"\w+(?:['’]\w+)*"
_MIXED = rf"(?:(?![{_for_re(CJK)}])\w)+(?:['’](?:(?![{_for_re(CJK)}])\w)+)*"
_RE_PLAIN = re.compile(rf"[#@$]?{_PLAIN}|[{_for_re(PICTURES)}]+")
_RE_MIXED = re.compile(rf"[#@$]?{_MIXED}|[{_for_re(CJK)}]+|[{_for_re(PICTURES)}]+")
_RE_LINK = re.compile(LINK, re.ASCII)


def tokens_and_link(text: str) -> tuple[list[str], bool]:
    """All tokens of a text, stopwords kept, and whether a link was in it."""
    text = (text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)).lower()
    link = False
    if "http" in text or "www." in text:
        text, n = _RE_LINK.subn(" ", text)
        link = n > 0
    if text.isascii():
        runs = _RE_PLAIN.findall(text)
        if not ("#" in text or "@" in text or "$" in text):
            return runs, link
    else:
        runs = (_RE_MIXED if _RE_CJK.search(text) else _RE_PLAIN).findall(text)
    out: list[str] = []
    for run in runs:
        c = run[0]
        if c in "#@$":
            word = run[1:].replace("’", "'")
            out += [word] if c == "$" and all(unicodedata.category(x)[0] == "N" for x in word) else [c + word, word]
        elif c.isascii():
            out.append(run.replace("’", "'"))
        elif _RE_CJK.match(c):
            out += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
        elif _RE_PICTURES.match(c):
            out += dict.fromkeys(run)
        else:
            out.append(run.replace("’", "'"))
    return out, link


def tokenize(text: str, keep_stopwords: bool = False) -> list[str]:
    every, _ = tokens_and_link(text)
    stop = () if keep_stopwords else frozenset(lexicons.stopwords())
    return [t for t in every if t not in stop]


def aspect_triggers(lexicon: dict) -> frozenset[str]:
    """Words one of which any aspect needs: single patterns, and the first words of phrases."""
    return frozenset(p.split(" ")[0] for patterns in lexicon.values() for kind in patterns.values() for p in kind)


def aspects_of(tokens: list[str], raw: str, lexicon: dict | None = None) -> list[str]:
    """Aspects of a token stream; the rules of ``aspect_tags`` for one text."""
    padded, present, found = f" {' '.join(tokens)} ", set(tokens), []
    hit = lambda ps: any(p in present if " " not in p else f" {p} " in padded for p in ps)
    for name, patterns in (lexicon or lexicons.aspects()).items():
        weak = patterns["weak"]
        if hit(patterns["strong"]) or (hit(weak) and any(not t.startswith("~") and t not in weak for t in tokens)) or (name == "~price" and re.search(r"\$[0-9]", raw)):
            found.append(name)
    return sorted(found)
