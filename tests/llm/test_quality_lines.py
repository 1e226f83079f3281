"""What one line may cost: long clean lines stay, bars, short phrases and lines without any sentence go."""

from logfold.llm.quality_rules import quality_rules

LONG = " ".join(f"Sentence {i} tells of item{i * 7} in plain words." for i in range(30))
LETTERS = [f"{a}{b}" for a in "kmnrst" for b in "aeiou"]
ROWS = [
    (1, LONG + " The last word lacks its", True), (2, LONG + " Then please sign in and read the privacy policy here.", True),
    (3, " ".join(f"शब्द{i}" for i in range(30)) + "।", True), (4, " ".join(LETTERS), False),
    (5, "Please sign in or subscribe to our newsletter and read the privacy policy now.", False),
    (6, " ".join(f"click here {w} privacy policy" for w in LETTERS) + ".", False),
]


def test_cost_of_a_line(spark):
    docs = spark.createDataFrame([r[:2] for r in ROWS], "doc_id bigint, text string")
    assert {r.doc_id: r.kept for r in quality_rules(docs).collect()} == {i: kept for i, _, kept in ROWS}
