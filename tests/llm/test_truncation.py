import random

from quern.llm.truncation import find_truncated, truncation_report

SENTENCES = [
    "The council counted {n} nests with help from Kovani Ltd.", "In {n} homes, residents saved water without extra staff, budget, etc.", "Results vary, e.g. in towns where only {n} of the sites reported.",
    "Ferry crews moved {n} parcels by rail vs. {n} in the control area.", "“We started small. Now we reach {n} towns,” said Prof. Dola.", "What changed?",
]


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    say = lambda: rng.choice(SENTENCES).replace("{n}", str(rng.randint(2, 900)))
    rows, cut = [], set()
    for i in range(n):
        text = " ".join(say() for _ in range(rng.randint(2, 6)))
        if i % 3 == 0:
            text += f"\n\nContact: Kova {rng.choice(['Rail', 'Water'])} Office press desk"
        elif i % 11 == 1:
            where = ["wharf", "depot", "mill", "square", "market", "bridge", "island", "quarry", "meadow", "library", "theatre", "garden"]
            text += f" They moved it to the {rng.choice(where)} and the {rng.choice(where)}. ({rng.choice(['Kova Health Network', 'Lunu Port Authority'])})"  # a signature, and nothing lost
        elif i % 5 == 0:
            text += " " + SENTENCES[0].replace("{n}", "77")
            at = rng.randint(20, len(text) - 12)
            while text[at - 1] in ' .,?”' or text[:at].rstrip().endswith((".", "?", "”")) or at > len(text) - 4:
                at -= 1
            text = text[:at] + rng.choice(["", "", "…", " [...]"])
            cut.add(i)
        rows.append((i, text, f"s{i % 4}", i % 2 == 0))
    return rows, cut


def test_cuts_are_found_and_ends_are_not(spark):
    rows, cut = corpus()
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, truncated BOOLEAN")
    found = find_truncated([(df, "documents", "doc_id", "text", "source")])
    got = {r.row_no for r in found.where("cut").collect()}
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut) <= 0.02 * len(rows)
    report = truncation_report(found).collect()
    assert sum(r.texts for r in report) == len(rows) and sum(r.cut for r in report) == len(got)


def test_nulls_blanks_and_empty_tables(spark):
    schema = "doc_id BIGINT, text STRING, source STRING, kind STRING, h3 INT"
    odd = [(1, None, "a", "k", 1), (2, "", None, None, None), (3, " \n\t", "a", "k", 2), (4, "…", "a", "k", 3), (5, "x" * 50_000, "a", "k", 4), (6, "Whole sentence.", None, "k", 5), (6, "Whole sentence.", None, "k", 5)]
    found = find_truncated([(spark.createDataFrame(odd, schema), "documents", "doc_id", "text", "source")])
    assert {r.row_no for r in found.collect()} <= {4, 5, 6}
    assert find_truncated([(spark.createDataFrame([], schema), "documents", "doc_id", "text", "source")]).count() == 0
