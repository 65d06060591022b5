import tracemalloc
import unicodedata

import pyarrow as pa
import pytest

from memlake.functions import unicode as U

TEXTS = ["Straße ÉCOLE Ⅷ", "plain ASCII, C++ and C#", None, "", "İstanbul ﬁń", "a\tb\x1fc", "日本語 Text", "ǅ ß"]


@pytest.mark.parametrize("udf,rule", [
    (U.fold, lambda s: "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c))),
    (U.canonical_name, lambda s: " ".join("".join(c if c.isalnum() or c in "+#" else " " for c in s.casefold()).split())),
])
def test_texts_are_python_strings_few_at_a_time(udf, rule):
    every = TEXTS + [chr(c) + "x" for c in range(256)]
    assert udf.func(pa.array(every)).to_pylist() == [None if t is None else rule(t) for t in every]
    many = pa.array(["Wörter und words " * 250] * 4_000)
    tracemalloc.start()
    assert len(udf.func(many)) == 4_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 << 20 < many.nbytes
