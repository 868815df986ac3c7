"""What findings of the third round were about: ties of evidence, and memory of a task."""

import random
import re

from tessellum.operators import extraction as E
from tessellum.operators import relational as R
from tessellum.operators import retrieval as Q
from tessellum.operators import structure as S


def test_equal_scores_of_evidence_in_another_order_of_sums(spark):
    """the first of equal hits is the evidence, however their scores were added up."""
    hits = [(1, "a", 0.1 + 0.2 + 0.3, 2), (1, "b", 0.3 + 0.2 + 0.1, 1), (1, "c", 0.5, 0), (2, "d", 0.7, 5), (2, "e", 0.7 + 1e-6, 6)]
    rows = spark.createDataFrame(hits, "query_id long, content string, score double, arrival int").selectExpr(
        "query_id", "'fragment' as intent", "'s' as section_id", "1 as doc_id", "content as element_id", "'t' as title", "content", "'fragment' as content_type", "1 as page", "score", "'bm25' as source", "arrival"
    )
    assert hits[0][2] != hits[1][2]
    assert {r["query_id"]: r["evidence"]["content"] for r in Q.fuse(rows).collect()} == {1: "b", 2: "e"}


def test_equal_names_are_not_sorted(spark):
    """the rows of a lexicon meet a hash aggregate before any sort; the last of equal terms stays, nulls too."""
    rows = [(i, f"Name{i % 3}", "Protein" if i % 2 else None, ["Ａ１", "B", None][: i % 4]) for i in range(60)]
    rows += [(60, None, "Metric", None), (61, "", "Metric", ["b", ""]), (None, "name1", "Reagent", None), (None, "lone", None, ["only"])]
    found = E.lexicon(spark.createDataFrame(rows, "ord long, canonical string, type string, aliases array<string>"))
    want = {}
    for n, canonical, kind, aliases in rows:
        for at, name in enumerate([canonical, *(aliases or [])]):
            for k, term in enumerate([name, name and name.translate({0xFF21: "A", 0xFF11: "1"})]):
                if term and ((-1 if n is None else n), at, k) > want.get(term.lower(), ((-2,),))[0]:
                    want[term.lower()] = ((-1 if n is None else n), at, k), canonical, kind, E.PRIORITIES.get(kind, 99)
    assert {r["term"]: (r["canonical"], r["type"], r["priority"]) for r in found.collect()} == {k: v[1:] for k, v in want.items()}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert re.findall(r"(\w+Aggregate)\(", plan)[-1] == "HashAggregate"


def joined_stats(files, sections, figures, tables, lines):
    """The left joins of `structure_stats`, row by row."""
    near = lambda rows, key: rows and [r for r in rows if key is not None and r[0] == key] or [None]
    out = {}
    for id_, name in files:
        at = out.setdefault((id_, name), [set(), set(), set(), set(), [], []])
        for s in near(sections, id_):
            for f in near(figures, s and s[1]):
                for t in near(tables, s and s[1]):
                    for line in near(lines, t and t[1]):
                        at[0].add(s and s[1]), at[1].add(f and f[1]), at[2].add(t and t[1]), at[3].add((t[1], line[1]) if line and line[1] is not None else None)
                        at[4] += [t[2]] if t and t[2] is not None else []
                        at[5] += [t[3]] if t and t[3] is not None else []
    return sorted((*k, *(len(x - {None}) for x in v[:4]), sum(v[4]) if v[4] else None, round(sum(v[5]) / len(v[5]), 4) if v[5] else None) for k, v in out.items())


def test_joined_rows_are_not_made(spark):
    """the figures of joined children without their product, with repeated ids and nulls."""
    files = [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")]
    sections = [(1, "s1"), (1, "s2"), (1, "s2"), (2, "s3"), (2, None), (3, "s4"), (9, "s1")]
    figures = [("s1", "f1"), ("s1", "f2"), ("s2", "f1"), ("s3", "f3"), ("s3", None), (None, "f9")]
    tables = [("s1", "t1", 2, 3), ("s1", "t2", 1, None), ("s2", "t1", 5, 1), ("s3", "t3", None, None), ("s3", None, 7, 2), (None, "t1", 8, 8)]
    lines = [("t1", 0), ("t1", 1), ("t1", 1), ("t1", None), ("t2", 0), ("t9", 0), (None, 0)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = R.structure_stats(
        frame(files, "id long, filename string"), frame(sections, "doc_id long, section_id string"), frame(figures, "section_id string, elem_id string"),
        frame(tables, "section_id string, elem_id string, n_rows int, n_cols int"), frame(lines, "table_elem_id string, row_index int"),
    )
    assert sorted(map(tuple, found.collect())) == joined_stats(files, sections, figures, tables, lines)
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_sorted_once(spark):
    """F32: sections and places in them from windows in one order."""
    rng = random.Random(7)
    rows = [(d, i, rng.choice(["Title", "NarrativeText", "Header", "Table", "Other"]), f"t{i}", 1) for d in range(40) for i in range(rng.randrange(1, 12))]
    rows += [(90, 0, None, "x", 1), (90, 1, "Title", "y", 1), (90, 2, None, "z", 1), (90, 3, "Title", " ", 1), (90, 4, "Text", "w", 1)]
    found = S.blocks(spark.createDataFrame(rows, "doc_id long, elem_index int, elem_type string, text string, page int"))
    want, last = set(), {}
    for d, i, kind, text, _ in rows:
        if text.strip():
            section, order = last.get(d, (1, 0))
            section, order = (section + 1, 1) if kind in ("Title", "Header") and d in last else (section, order + 1)
            last[d] = section, order
            want.add((d, i, section, order))
    assert {(r["doc_id"], r["elem_index"], r["section_no"], r["order"]) for r in found.collect()} == want
    assert dict(found.dtypes)["order"] == "int"
    assert len(re.findall(r"\bSort \[", found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1])) == 1
