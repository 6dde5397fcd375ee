import random

import pytest

from keyloom.llm import leaks as L

WORDS = "Suppose that the cooled manifold often narrows the steep matching through a flat scheduler so halzolvér exceeds the reactor".split()


@pytest.mark.parametrize(
    "text",
    [
        " ".join(WORDS[2:14]),
        " ".join(WORDS).upper(),
        "% " + "\n% ".join(" ".join(WORDS[i : i + 4]) for i in range(0, len(WORDS), 4)),
        "\\emph{" + WORDS[5] + "} " + "~\\cite{x2001} ".join(WORDS[6:19]) + ".",
        " ".join(WORDS[4:19]).replace("é", "\\'{e}"),
        " ".join(WORDS[4:19]).replace("é", "{\\'e}"),
        " ".join(WORDS[4:19]).replace("é", "e\u0301"),
        ",\r\n ".join(WORDS[1:15]),
        "{\\it " + WORDS[3] + "} " + " ".join(WORDS[4:16]),
        "\\iffalse " + " ".join(WORDS) + " \\fi",
    ],
)
def test_disguised_passages(text):
    m = L.matcher([(7, " ".join(WORDS)), (8, "other words " * 20)])
    assert L.leaked("Before. " + text + " after", m) == [7]


def test_eleven_words_are_none():
    m = L.matcher([(7, " ".join(WORDS))])
    assert L.leaked(" ".join(WORDS[3:14]) + " x", m) == []
    assert L.leaked(" ".join(WORDS[:6]) + " x " + " ".join(WORDS[6:]).replace("flat", "y"), m) == []


def test_chinese_letters():
    item = "稀疏的催化剂往往揭示了混沌的岩层与波形，从而嵌套的介质明显地揭示了周期的土壤。"
    m = L.matcher([(1, item)])
    assert L.is_han(item) and not L.is_han("強い系が有限な軌道と電流を遅らせる。のであるこれはかな") and not L.is_han("")
    assert L.leaked("abc% 稀疏的催化剂往往揭示了混\n% 沌的岩层与波形从而", m) == [1]
    assert L.leaked("稀疏的催化剂往往揭示了混沌的岩层与波", m) == []


@pytest.mark.parametrize("seed", range(5))
def test_search_equals_brute_force(seed):
    rnd = random.Random(seed)
    items = [[rnd.choice("abc") for _ in range(rnd.randint(0, 30))] for _ in range(12)]
    p = L.compile_patterns(items, 6)
    letters = L.compile_patterns(["".join(i) for i in items], 6)
    for _ in range(60):
        text = [rnd.choice("abcd") for _ in range(rnd.randint(0, 80))]
        windows = {tuple(text[i : i + 6]) for i in range(len(text) - 5)}
        want = {k for k, u in enumerate(items) if any(tuple(u[i : i + 6]) in windows for i in range(len(u) - 5))}
        assert L.search(text, p) == want == L.search("".join(text), letters)


def test_table_in_sets_nulls_and_repeats(spark):
    items = [(1, " ".join(WORDS)), (2, "short"), (3, None), (4, ""), (1, " ".join(WORDS)), (5, " ".join(f"w{i}" for i in range(40)))]
    docs = [(1, "x " + " ".join(WORDS)), (1, "x " + " ".join(WORDS)), (2, None), (3, ""), (4, "y " * 200_000 + " ".join(f"w{i}" for i in range(15))), (5, "nothing")]
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, item_id int, lang string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    for size in (L.SET_CHARS, 60):
        assert sorted(map(tuple, L.find_leaks(d, i, size).collect())) == [(1, 1), (4, 5)]
    assert L.find_leaks(d.limit(0), i).collect() == [] and L.find_leaks(d, i.limit(0)).collect() == []
