import re
import time

import pytest

from phylospan.llm import pii, pii_training


@pytest.fixture(scope="module")
def weights():
    return pii.fitted_weights()


def found(text, weights):
    return {(k, text[a:b]) for a, b, k in pii.find_in_text(text, weights)}


#: Sentences and names that are no part of the fit, {..} marks a name.
NAMES_IN_SENTENCES = """
{Gunnar Lindqvist} designed the mill.
{Yolanda Pereira} was a nurse in the war.
We met {Fatoumata Diallo} at noon.
{Siobhan Gallagher} wrote the second verse.
[[{Wanda Sobczak}]] inherited it in 1931.
The portrait was painted by {Ingeborg Aasen}.
According to {Takeshi Morimoto}, the bridge had collapsed.
Mrs. {Adebayo Ogunleye} opened the library.
a letter by {Chiara Bellini} was found
Her colleague thanked {Dmitri Volkov} for it.
{Zsófia Kovács} built the tower.
Herr {Wolfgang Steinmetz} besuchte die Ausstellung.
Laut {Annegret Vogelsang} war niemand dort.
{Friedhelm Krause} gründete den Verein.
Selon {Maëlys Rousseau}, le pont est fermé.
Mme {Océane Lefèvre} quitta la ville.
Écrit par {Thibault Garnier}.
Según {Joaquín Etxeberria}, no pasó nada.
La Sra. {Rosario Villalobos} visitó el pueblo.
{Ignacio Zubizarreta} fundó la escuela.
| author = {Kwabena Asante}
| photographer = {Ludmila Horáková}
Reported by {J. Haverkamp} in May.
Dr. {Papadopoulos, Eleni} led the project.
Everybody knows {Nils Ekström} is late
'''{Hedda Sørensen}''' (1851-1920) was a painter.
Port Lindqvist lies on the coast.
The Harbour Bridge closed in 2004.
Lake Pereira is deep.
die Werkstatt von Hohenfels brannte 1920.
near Upper Sobczak, the road ends
BUY CHEAP WATCHES NOW
[[Category:Old Mills]]
the clerk of Great Morimoto sold the farm
''Quercus roburensis'' grows near Sandvik.
""".strip().split("\n")


def test_held_out_names(weights):
    """Real names in other sentences: nine of ten are found, and nine of ten found ones are right."""
    good = total = wrong = 0
    for line in NAMES_IN_SENTENCES:
        want = set(re.findall(r"\{(.*?)\}", line))
        got = {x for k, x in found(re.sub(r"[{}]", "", line), weights) if k == "name"}
        good, total, wrong = good + len(got & want), total + len(want), wrong + len(got - want)
    assert total == 26 and good >= 0.9 * total and wrong <= 0.1 * total


def test_held_out_fillings(weights):
    """The sentences of the fit with other values."""
    good = total = wrong = 0
    for text, gold in pii_training.examples(copies=2, seed=99):
        got = set(pii.find_in_text(text, weights))
        good, total, wrong = good + len(got & set(gold)), total + len(gold), wrong + len(got - set(gold))
    assert good / total > 0.95 and wrong / total < 0.03


def test_time_is_linear_in_capitalised_words(weights):
    took = []
    for n in (2_500, 10_000):
        text = " ".join(f"Gunnar Lindqvist{chr(97 + k % 26)}" for k in range(n // 2))
        began = time.perf_counter()
        pii.find_in_text(text, weights)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Write to ann.lee (at) post.uni (dot) example today.", {("email", "ann.lee (at) post.uni (dot) example")}),
        ("Mail bob&#64;mail.test. The end", {("email", "bob&#64;mail.test")}),
        ("call +1-495-555-0131 ext. 14 and ask", {("phone", "+1-495-555-0131 ext. 14")}),
        ("| phone = (580) 555-0189\n}}", {("phone", "(580) 555-0189")}),
        ("SSN 900-10-6648 was printed on the form.", {("id_number", "900-10-6648")}),
        ("the permit lists QQ 39 94 40 B as the holder's tax number", {("id_number", "QQ 39 94 40 B")}),
        ("She still lives at Unit 12, 14 Mill St..", {("address", "Unit 12, 14 Mill St.")}),
        ("Post an: Lindenweg 70a\n", {("address", "Lindenweg 70a")}),
        ("Courrier : 11 bis rue des Lilas Le pont", {("address", "11 bis rue des Lilas")}),
        ("Cartas a: Calle del Olmo, 135, bajo", {("address", "Calle del Olmo, 135, bajo")}),
        ("Dr. Torastel, Victor led the dig of 1932.", {("name", "Torastel, Victor")}),
        ("| autor = Mateo J. Lemkorin\n", {("name", "Mateo J. Lemkorin")}),
        ("According to Hugh Dalozan, the garden was empty.", {("name", "Hugh Dalozan")}),
        ("Tel:+1-433-555-0134, Phone 555-0199", {("phone", "+1-433-555-0134"), ("phone", "555-0199")}),
        ("card 4111 1111 1111 1111 was charged", set()),
        ("She lives at 7 Harbour View.", {("address", "7 Harbour View")}),
        ("deliver to: 14 Elm Parkway", {("address", "14 Elm Parkway")}),
        ("| indirizzo = Via Roma 12", {("address", "Via Roma 12")}),
        ("Port Hugh lies on the bay. [[User:Wren_41]] 18:18", set()),
        ("see revision 73306220 and diff 48245828", set()),
        ("Population 6 885 198 (1915-2018). ISBN 978-7-41-884787-1", set()),
        ("plants kept @ 39 degrees; the Mill Lane stop opened in 1981", set()),
        ("", set()),
        ("9" * 5000 + " " + "A" * 5000 + "@" * 500, set()),
    ],
)
def test_cases(weights, text, expected):
    assert found(text, weights) == expected


def test_marginals_are_consistent(weights):
    """The expected counts of the forward-backward sums equal those by listing all segmentations."""
    import itertools
    import math

    text = "Laut Ute Dieter Koliskel war das Archiv leer."
    items = pii.scored(text, pii.candidates(text))
    scores = [sum(weights.get(n, 0.0) for n in x[3]) / 5 for x in items]
    total, per = 0.0, [0.0] * len(items)
    for size in range(len(items) + 1):
        for pick in itertools.combinations(range(len(items)), size):
            spans = sorted((items[k][0], items[k][1]) for k in pick)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:])):
                p = math.exp(sum(scores[k] for k in pick))
                total += p
                for k in pick:
                    per[k] += p
    assert [x / total for x in per] == pytest.approx(pii._expected(items, [s for s in scores]))


def test_operators(spark):
    text = "According to Hugh Dalozan, call 020 7946 0225. Hugh Dalozan left."
    df = spark.createDataFrame([(1, text, "k"), (1, text, "k"), (2, None, "k"), (3, "", "k"), (4, "plain", "k")], "doc_id bigint, text string, kind string")
    got = {tuple(r) for r in pii.find_personal(df).collect()}
    assert got == {(1, "name", "Hugh Dalozan"), (1, "phone", "020 7946 0225")} and pii.find_personal(df).count() == 2
    clean = pii.redact_personal(df).collect()
    assert sorted((r.doc_id, r.text or "", r.kind) for r in clean) == [
        (1, "According to [NAME], call [PHONE]. Hugh Dalozan left.".replace("Hugh Dalozan", "[NAME]"), "k"), (1, "According to [NAME], call [PHONE]. [NAME] left.", "k"), (2, "", "k"), (3, "", "k"), (4, "plain", "k"),
    ]
    assert {r.text for r in clean if r.doc_id == 2} == {None}
    assert pii.find_personal(df.where("false")).count() == 0
