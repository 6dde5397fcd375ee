import os
import random
import time

import pyarrow.parquet as pq
import pytest

from keyloom.llm import sentences as S
from keyloom.llm import transducer as T


def split(text):
    """The sentences that end at the found places, each from the one before."""
    ends = S.sentence_ends(text)
    return [text[a:b].strip() for a, b in zip([0, *ends], ends)]


CASES = [
    ("Dr. Low et al. report 3.5 cm, e.g. in Fig. 2. It holds.", ["Dr. Low et al. report 3.5 cm, e.g. in Fig. 2.", "It holds."]),
    ("As in K. Low et al. The end.", ["As in K. Low et al.", "The end."]),
    ("As in Low et al. \\cite{a} it holds. Yes.", ["As in Low et al. \\cite{a} it holds.", "Yes."]),
    ("Mesh, eddy, etc. The end, etc., is near.", ["Mesh, eddy, etc.", "The end, etc., is near."]),
    ("Release v3.1.4 of a.io works. 5.4 runs agree vs. 2.1 here.", ["Release v3.1.4 of a.io works.", "5.4 runs agree vs. 2.1 here."]),
    ("The soil ... and the mesh hold. So", ["The soil ... and the mesh hold.", "So"]),
    ("The claim “It holds.” does not cover it. (See it.) “It ends.” Next one.", ["The claim “It holds.” does not cover it.", "(See it.)", "“It ends.”", "Next one."]),
    ('"Is it so?" remains open. He says ``so it is.\'\' Then.', ['"Is it so?" remains open.', "He says ``so it is.''", "Then."]),
    ("It is 5.3\\%. At 24~a.u. The end.", ["It is 5.3\\%.", "At 24~a.u.", "The end."]),
    ("Am 25. August lag er bei 3. Die Fläche, z.~B. Abb. 3.\nNach Nr. 8 usw. Am 3. Mai „Die Nähe.“ ist es.", ["Am 25. August lag er bei 3.", "Die Fläche, z.~B. Abb. 3.", "Nach Nr. 8 usw.", "Am 3. Mai „Die Nähe.“ ist es."]),
    ("Selon M. Low et al., oui. « La roche. » reste la formule de Mme. Nod. Pourquoi ? La fin.", ["Selon M. Low et al., oui.", "« La roche. » reste la formule de Mme. Nod.", "Pourquoi ?", "La fin."]),
    ("Сигнал, т. е. см. рис. 5 и табл. 2. Слабая и т. д. «Сигнал!» остаётся. По данным проф. Д. У. Велкова, да.", ["Сигнал, т. е. см. рис. 5 и табл. 2.", "Слабая и т. д.", "«Сигнал!» остаётся.", "По данным проф. Д. У. Велкова, да."]),
    ("稳定约 5,258.5．随机的（见第 0.7 节）；局部。为何？有人写道：“早期。”而整体。", ["稳定约 5,258.5．", "随机的（见第 0.7 节）；局部。", "为何？", "有人写道：“早期。”而整体。"]),
    ("「強い。」と述べた者もいる…と考えられる。図1である。", ["「強い。」と述べた者もいる…と考えられる。", "図1である。"]),
    ("डॉ. Rost के अनुसार 7.85। “प्रबल है।” यह कथन अधूरा है। क्या यह है? हाँ.", ["डॉ. Rost के अनुसार 7.85।", "“प्रबल है।” यह कथन अधूरा है।", "क्या यह है?", "हाँ."]),
    ("يرى د. Low أن الطور! هل الوسط؟ «النظام.» قول لا يكفي. نعم.", ["يرى د. Low أن الطور!", "هل الوسط؟", "«النظام.» قول لا يكفي.", "نعم."]),
    ("ระบบที่เรียบ ถ้า $x$ แล้ว 7.9 หน่วย\nคลื่น", ["ระบบที่เรียบ", "ถ้า $x$ แล้ว 7.9 หน่วย", "คลื่น"]),
    ("It damps,\n\\begin{equation}\n a = 1.\n\\end{equation}\nwhere $a$ holds.\n\n\\begin{align} b \\end{align}\nNext.", None),
    ("One \n% old: Ask. Now!\ntwo\\footnote{See Sec. 9. X.} three. % Yes.\nFour.", None),
    ("We note:\n\\begin{itemize}\n\\item first no. 3\n\\item Second. Third.\n\\end{itemize}\nEnd", None),
    ("A.\\section{Data, etc.}\nB \\iffalse C. D. \\fi e.", None),
]


@pytest.mark.parametrize("text,want", CASES)
def test_boundaries(text, want):
    if want:
        assert split(text) == want


def last_chars(text):
    return [text[max(0, p - 6) : p] for p in S.sentence_ends(text)]


def test_markup():
    assert last_chars(CASES[-4][0]) == ["holds.", "\nNext."]
    assert last_chars(CASES[-3][0]) == ["three.", "\nFour."]
    assert last_chars(CASES[-2][0]) == [" note:", " no. 3", "econd.", "Third.", "e}\nEnd"]
    assert [c[-2:] for c in last_chars(CASES[-1][0])] == ["A.", "e."]
    doc = "\\title{A. B.}\n\\begin{document}\n\\maketitle\n\\begin{abstract}\nOne. Two\n\\end{abstract}\n\\begin{figure}\n\\caption{See it. Now.}\n\\end{figure}\nThree.\n\\begin{thebibliography}{9}\n\\bibitem{a} X. Y.\n\\end{thebibliography}\n\\end{document}"
    assert [c[-4:] for c in last_chars(doc)] == ["One.", " Two", "ree."]
    assert last_chars("\\input{a.b}\n") == [] == last_chars("") == last_chars("% only. This!")


def fragments(rnd):
    parts = ["The mesh holds. ", "As in K. Low et al. ", "\n\n", "\n", "$a_1 = 2.5$ ", "\\[ x. \\]\n", "\\begin{equation}\n", "\\end{equation}\n", "\\iffalse\n", "\\fi\n", "“It is. ", "” ", "(see Fig. 2) ", "{", "}", "\\footnote{See. ", "\\section{", "% c. D\n", "\\item ", "ระบบ คลื่น\n", "系。", "。」", "「", "\\begin{comment}\n", "\\end{comment}\n", "\\begin{document}\n", "\\end{document}\n", "... and ", "no. 5 ", "25. ", "August ", "word ", "\\em{} ", '"', "\\begin{figure}\n", "\\end{figure}\n", "\\cite{a} ", "\\foo{} ", "$$", "$", "\\(", "\\)", "\\else\n", "\\ifx\n", "}}}\n", "{{{", "\\marginpar", "long plain words without any end " * 8, "%" + " comment. Here" * 20, "\r\n", "\\begin{thebibliography}{9}\n"]
    return "".join(rnd.choice(parts) for _ in range(rnd.randint(20, 120)))


def chunked(text, size):
    """Ends by chunks, each from the state that the functions of those before it give."""
    parts = S._chunks(text, size)
    fs = [S.chunk_function(x[-1], x[3], x[4], x[1], x[5]) for x in parts]
    m, c, out = S.first_markup(text), T.Config(), []
    for x, f in zip(parts, fs):
        end = []
        behind = T.read(S.lex(x[-1], x[3], x[4], x[1], m, x[5], end), c, out)
        m, c = S.through(f, m, c)
        assert end == [m] and behind.state == c.state
        out += T.finish(behind) if x[6] else []
    assert S.through(composed(fs), S.first_markup(text), T.Config()) == (m, c)
    return sorted(out)


def composed(fs):
    """All functions as one, by a tree."""
    if len(fs) < 2:
        return fs[0]
    return S.compose(composed(fs[: len(fs) // 2]), composed(fs[len(fs) // 2 :]))


@pytest.mark.parametrize("seed", range(40))
def test_chunks_compose_to_the_whole(seed):
    rnd = random.Random(seed)
    text = fragments(rnd)
    for size in (1, 60, 300, 2000):
        assert chunked(text, size) == sorted(S.sentence_ends(text)), size


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
@pytest.mark.parametrize("sf,size", [("sf0.001", 300), ("sf0.001", 1000), ("sf0.01", 3000), ("sf0.01", 20_000), ("sf0.01", 65_536)])
def test_chunks_of_whole_tables(sf, size):
    texts = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()
    for t in texts:
        if t and len(t) > size:
            assert chunked(t, size) == sorted(S.sentence_ends(t))


@pytest.mark.parametrize("depth", [5, 6, 7, 50])
def test_arguments_in_many_braces(depth):
    text = "One\\footnote{" + "{" * depth + "Inner one. Inner two." + "}" * depth + " Still. In it.} goes on. Two."
    assert split(text) == [text[: text.index(" Two.")], "Two."]
    assert chunked(text.replace(" ", "\n"), 1) == S.sentence_ends(text.replace(" ", "\n"))
    nested = "Yes. \\iffalse " + "\\ifx " * depth + "Not. Not. " + "\\fi " * depth + "Not. \\fi Now."
    assert [x[-4:] for x in split(nested)] == ["Yes.", "Now."]


def test_a_long_comment_is_no_prose_wherever_it_is_cut():
    text = "Start. " + "%" + " not read. At all" * 3000 + "\nNext one. Word " + "word " * 9000 + "end."
    want = S.sentence_ends(text)
    assert [text[p - 5 : p] for p in want] == ["tart.", " one.", " end."]
    for size in (500, 30_000, 65_536):
        assert chunked(text, size) == want
    assert len(S.cuts("word " * 9000, 500)) > 50  # a line of words is cut inside


def test_states_are_finite_and_their_table_is_closed():
    states = set(T.states())
    assert len(states) < 400 and all(T.TABLE[sym][s].state in states for sym in T.symbols() for s in states)


def test_one_paragraph_costs_little_more_than_a_reading():
    text = ("This is a plain sentence of usual length that ends. Another one follows it, as usual!\n" * 900)[:64_800]
    T.states(), S.sentence_ends(text)  # tables are made
    began = time.perf_counter()
    S.sentence_ends(text)
    read = time.perf_counter() - began
    began = time.perf_counter()
    S.chunk_function(text, 0, len(text), 0, False)
    assert time.perf_counter() - began < 30 * read  # about 10 on a quiet machine


def test_scan_over_several_levels(spark):
    text = "\n".join(f"The mesh {i} holds. It ends {'in a' if i % 7 else '(see it'}" + ("\n" if i % 50 == 0 else "") for i in range(1500))
    assert len(S.cuts(text, 100)) > S.FAN**2
    got = S.sentences(spark.createDataFrame([(1, text), (2, "\\begin{document}\n" + text)], "doc_id long, text string"), 100).collect()
    assert sorted(map(tuple, got)) == sorted([(1, p) for p in S.sentence_ends(text)] + [(2, p) for p in S.sentence_ends("\\begin{document}\n" + text)])


def test_table(spark):
    long = "The mesh holds. It ends.\n" * 400 + "Open end"
    docs = [(1, "One. Two."), (2, None), (3, ""), (4, long), (5, "One. Two."), (6, "x" * 50_000)]
    df = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, end_pos int, state string")
    got = sorted(map(tuple, S.sentences(df, 2_000).collect()))
    assert got == sorted((i, p) for i, t in docs if t for p in S.sentence_ends(t))
    assert S.sentences(df.limit(0)).collect() == []


def test_repeated_and_null_ids_of_long_texts(spark):
    a, b = "The mesh holds. It ends.\n" * 200 + "Open end", "\\iffalse\n" + "Not read. At all.\n" * 150 + "\\fi\n" + "One. Two\n" * 150
    docs = [(1, a), (1, a), (1, b), (None, a), (None, b), (2**60 + 1, a)]
    got = S.sentences(spark.createDataFrame(docs, "doc_id long, text string"), 2_000).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, p)) for i, t in docs for p in S.sentence_ends(t))
