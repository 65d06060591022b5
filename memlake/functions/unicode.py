"""Text rules that need Unicode tables: folding, names, stems, name similarity. Arrow-batched where no builtin exists."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from memlake.functions.text import STOP_WORDS

#: Texts that are Python strings at once.
AT_ONCE = 128
CJK = r"[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]"


def folded(text: str) -> str:
    """Case-folded, decomposed, without combining marks."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def each_text(rule: Callable[[str], str], texts: pa.Array) -> pa.Array:
    """rule of every text that isn't null, few texts at a time: a batch of whole texts is never held as Python strings."""
    parts = [pa.array([None if t is None else rule(t) for t in texts.slice(a, AT_ONCE).to_pylist()], pa.string()) for a in range(0, len(texts), AT_ONCE)]
    out = pa.concat_arrays([pa.array([], pa.string()), *parts])
    del parts
    pa.default_memory_pool().release_unused()
    return out


@F.arrow_udf(StringType())
def fold(text: pa.Array) -> pa.Array:
    return each_text(folded, text)


def search_tokens(text: Column) -> Column:
    """Search tokens of a text: folded words without stop words and single characters.

    A word with characters of a script without word boundaries stays whole and
    is also cut into pairs of neighbouring characters.
    """
    return tokens_of(fold(text))


def tokens_of(folded_text: Column) -> Column:
    """Search tokens of a text that is folded already."""
    words = F.regexp_extract_all(folded_text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def parts(w: Column) -> Column:
        pairs = F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 1)), lambda i: F.substr(w, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        plain = F.when((F.length(w) > 1) & ~w.isin(*STOP_WORDS), F.array(w)).otherwise(F.array().cast("array<string>"))
        return F.when(w.rlike(CJK), F.concat(F.array(w), pairs)).otherwise(plain)

    # most texts have no such script, so no word of them is cut
    return F.when(folded_text.rlike(CJK), F.flatten(F.transform(words, parts))).otherwise(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)))


#: ASCII characters of names in lower case, all others blank.
_NAMED = {c: chr(c).lower() if chr(c).isalnum() or chr(c) in "+#" else " " for c in range(128)}


def _named(text: str) -> str:
    if text.isascii():
        return " ".join(text.translate(_NAMED).split())
    return " ".join("".join(c if c.isalnum() or c in "+#" else " " for c in text.casefold()).split())


@F.arrow_udf(StringType())
def canonical_name(text: pa.Array) -> pa.Array:
    """Case-folded words of letters, digits, '+' and '#', one space apart."""
    return each_text(_named, text)


# ---- stems: the published algorithm of M. F. Porter, "An algorithm for suffix stripping" (1980)

VOWELS = "aeiou"
# The suffixes of steps 2, 3 and 4 and what they become.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_STEP_2, _STEP_3, _STEP_4 = dict(STEP_2), dict(STEP_3), tuple(STEP_4)


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        vowel = letter in VOWELS or (letter == "y" and k > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _ends_short(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, suffixes: tuple[str, ...]) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len) if word.endswith(suffixes) else None


def porter_stem(word: str) -> str:
    """Stem of a lower-case word of a-z; any other word is its own."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _ends_short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP_2, _STEP_3):
        cut = _longest(word, tuple(table))
        if cut and _measure(word[: -len(cut)]) > 0:
            word = word[: -len(cut)] + table[cut]
    cut = _longest(word, _STEP_4)
    if cut and _measure(word[: -len(cut)]) > 1 and (cut != "ion" or word[: -len(cut)].endswith(("s", "t"))):
        word = word[: -len(cut)]
    if word.endswith("e"):
        size = _measure(word[:-1])
        if size > 1 or (size == 1 and not _ends_short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def stem(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}
    for batch in words:
        for w in batch.dropna().unique():
            if w not in known:
                known[w] = porter_stem(w)
        yield batch.map(known, na_action="ignore")


# ---- similarity of names


def jaro_similarity(a: str, b: str) -> float:
    """Jaro similarity: share of letters that meet within half the longer length, less half the ones out of order."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    met: list[tuple[str, int]] = []
    for i, letter in enumerate(a):
        at = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == letter), None)
        if at is not None:
            free[at] = False
            met.append((letter, at))
    if not met:
        return 0.0
    in_order = [b[j] for j in sorted(j for _, j in met)]
    moved = sum(x != y for (x, _), y in zip(met, in_order, strict=True)) // 2
    m = len(met)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3.0


def winkler_similarity(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth of what is missing for each of up to four equal first letters."""
    plain = jaro_similarity(a, b)
    same = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return plain + same * 0.1 * (1.0 - plain)


def prefix_similarity(a: str, b: str) -> float:
    """0.95 where one name begins with the other, which has 0.6 of its letters at least; else 0."""
    short, long = sorted((a, b), key=len)
    return 0.95 if short and long.startswith(short) and len(short) >= 0.6 * len(long) else 0.0


def _on_pairs(f):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


jaro = _on_pairs(jaro_similarity)
jaro_winkler = _on_pairs(winkler_similarity)
prefix_score = _on_pairs(prefix_similarity)
name_similarity = _on_pairs(lambda a, b: max(winkler_similarity(a, b), prefix_similarity(a, b)))

# Short and other names of well-known things, and what they stand for.
SEED_ALIASES = {
    "postgres": "postgresql",
    "pg": "postgresql",
    "mongo": "mongodb",
    "k8s": "kubernetes",
    "kube": "kubernetes",
    "js": "javascript",
    "ts": "typescript",
    "py": "python",
    "python3": "python",
    "py3": "python",
    "rb": "ruby",
    "golang": "go",
    "rs": "rust",
    "cpp": "c++",
    "csharp": "c#",
    "node": "nodejs",
    "node js": "nodejs",
    "reactjs": "react",
    "react js": "react",
    "vuejs": "vue",
    "vue js": "vue",
    "next js": "nextjs",
    "gh": "github",
    "gl": "gitlab",
    "tf": "terraform",
    "np": "numpy",
    "pd": "pandas",
    "sklearn": "scikit learn",
    "tailwindcss": "tailwind",
    "es": "elasticsearch",
    "elastic": "elasticsearch",
    "ddb": "dynamodb",
    "gcp": "google cloud",
    "vs code": "vscode",
    "vsc": "vscode",
    "sqlite3": "sqlite",
    "yml": "yaml",
    "md": "markdown",
    "dockerfile": "docker",
    "psql": "postgresql",
}


def seed_alias(name: Column, more: dict[str, str] | None = None) -> Column:
    """What a canonical name stands for; ``more`` overrides the seeds."""
    table = SEED_ALIASES | (more or {})
    return F.coalesce(F.create_map(*[c for k, v in sorted(table.items()) for c in (F.lit(k), F.lit(v))])[name], name)
