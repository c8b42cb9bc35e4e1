import glob

import pytest
from pyspark.sql import functions as F

from gradelattice.operators import enumerate as en
from gradelattice.operators import metrics, containment
from gradelattice.operators.closure import ModalClosure
from gradelattice.sources import text, writers

ROWS = [[3, 7, 5, 0], [9, 4, 6, 10], [2, 8, 1, 1], [6, 6, 6, 6], [0, 0, 0, 3]]


def put(path, content):
    path.write_text(content)
    return str(path)


def document(folder):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{folder}/part-*")))


def cells(ctx):
    return {r.obj: r.grades for r in ctx.frame.collect()}


def test_line_breaks_do_not_matter(spark, tmp_path):
    path = put(tmp_path / "c.txt", "2\n3 0.1 0.2\n0.3\n\n  0.4 0.5 1 \n")
    assert cells(text.scan_context(spark, path)) == {0: [1, 2, 3], 1: [4, 5, 10]}


def test_context_over_many_blocks_and_files(spark, make, tmp_path):
    folder = str(tmp_path / "ctx")
    rows = [[(i * 7 + j) % 11 for j in range(4)] for i in range(300)]
    writers.write_lines(writers.context_lines(make(rows)), folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        expected = dict(enumerate(rows))
        assert cells(text.scan_context(spark, folder)) == expected
        assert cells(text.scan_aligned_context(spark, folder, 4)) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_context_text(make, tmp_path):
    writers.write_lines(writers.context_lines(make(ROWS[:2])), str(tmp_path / "c"))
    assert document(tmp_path / "c") == "2 4\n0.3 0.7 0.5 0.0\n0.9 0.4 0.6 1.0\n"


def test_strict_scans_name_the_cell(spark, tmp_path):
    short = put(tmp_path / "short.txt", "2 2 0.1 0.2 0.3")
    with pytest.raises(ValueError, match=r"I\[1\]\[1\]"):
        text.scan_context(spark, short)
    wrong = put(tmp_path / "wrong.txt", "2 2 0.1 x 0.3 0.4")
    with pytest.raises(Exception, match=r"I\[0\]\[1\]"):
        text.scan_context(spark, wrong).frame.collect()
    grade = put(tmp_path / "grade.txt", "1 2 1 0.5")
    with pytest.raises(Exception, match=r"I\[0\]\[1\]"):
        text.scan_context(spark, grade, scale=1).frame.collect()
    with pytest.raises(ValueError, match="header"):
        text.scan_context(spark, put(tmp_path / "none.txt", "\n"))
    assert cells(text.scan_context(spark, wrong, strict=False)) == {0: [1, 0], 1: [3, 4]}


def test_strict_scans_lose_nothing(spark, tmp_path):
    surplus = put(tmp_path / "surplus.txt", "2 2\n0.1 0.2\n0.3 0.4\n0.5 0.6\n")
    with pytest.raises(ValueError, match="2 too many"):
        text.scan_context(spark, surplus)
    with pytest.raises(ValueError, match="3 objects where 2"):
        text.scan_aligned_context(spark, surplus, 2)
    with pytest.raises(ValueError, match="2 attributes announced"):
        text.scan_aligned_context(spark, surplus, 3)
    for value in ("0.41", "1.5", "-0.1"):
        off = put(tmp_path / "off.txt", f"1 2\n{value} 0.4\n")
        for scan in (lambda: text.scan_context(spark, off), lambda: text.scan_aligned_context(spark, off, 2)):  # noqa: B023
            with pytest.raises(Exception, match=value):
                scan().frame.collect()
    half = put(tmp_path / "half.txt", "1 2\n0.5 1\n")
    with pytest.raises(Exception, match="0.5"):
        text.scan_aligned_context(spark, half, 2, scale=1).frame.collect()
    assert cells(text.scan_context(spark, put(tmp_path / "snap.txt", "1 2 0.41 0.44"), snap=True)) == {0: [4, 4]}


def test_lenient_scan_returns_all_objects(spark, tmp_path):
    short = put(tmp_path / "lenient.txt", "3 2 0.5 x 0.7")
    assert cells(text.scan_context(spark, short, strict=False)) == {0: [5, 0], 1: [7, 0], 2: [0, 0]}


def test_ids_beyond_the_announced_fail(spark, tmp_path):
    sets = put(tmp_path / "sets.txt", "{a1, a5},\n{a5},\n")
    with pytest.raises(Exception, match="a5"):
        text.scan_sets(spark, sets, 3).collect()
    assert {r.mask for r in text.scan_sets(spark, sets).collect()} == {17, 16}
    intents = put(tmp_path / "beyond.txt", "4 3 1\nI 0.8/0 0.9/7\n")
    with pytest.raises(Exception, match="0.9/7"):
        text.scan_intents(spark, intents).collect()
    with pytest.raises(Exception, match="beyond"):
        text.scan_sample_input(spark, intents).collect()
    with pytest.raises(ValueError, match="announced"):
        text.scan_intents(spark, intents, 8)
    with pytest.raises(Exception, match="0.85/0"):
        text.scan_intents(spark, put(tmp_path / "off.txt", "4 3 1\nI 0.85/0\n")).collect()
    words = put(tmp_path / "words.txt", "4 3 2\nIgnored line\nI 0.8/0\nI\n")
    assert [r.grades for r in text.scan_intents(spark, words).orderBy("id").collect()] == [[8, 0, 0], [0, 0, 0]]


def test_aligned_scan_rejects_ragged_lines(spark, tmp_path):
    ragged = put(tmp_path / "r.txt", "2 2\n0.1 0.2\n0.3\n")
    with pytest.raises(Exception, match="line 2"):
        text.scan_aligned_context(spark, ragged, 2).frame.collect()


def test_concept_sets(spark, tmp_path):
    path = put(tmp_path / "s.txt", "{a1, a3},\n{},\n\n{a3, a1},\n{a2},\n")
    assert {r.mask for r in text.scan_sets(spark, path, 3).collect()} == {5, 0, 2}


def test_intents_keep_first_and_limit(spark, tmp_path):
    path = put(tmp_path / "i.txt", "4 3 4\nI 0.800/0 0.300/2\nI\nI 0.300/2 0.800/0\nnote\nI 1.000/1\n")
    got = [(r.id, r.grades, r.card) for r in text.scan_intents(spark, path, 3).orderBy("id").collect()]
    assert got == [(0, [8, 0, 3], 2), (1, [0, 0, 0], 0), (2, [0, 10, 0], 1)]
    assert text.scan_intents(spark, path, 3, max_intents=2).count() == 2


def test_sample_input_reads_both_forms(spark, tmp_path):
    path = put(tmp_path / "m.txt", "4 3 3\nI 0 2\nI 0.800/0 0.000/1 0.300/2\nI\n")
    assert [(r.mask, r.card) for r in text.scan_sample_input(spark, path, 3).orderBy("line").collect()] == [(5, 2), (5, 2), (0, 0)]


def test_intent_file_round_trip(spark, make, tmp_path):
    intents = en.fuzzy_concepts(make([[8, 2], [5, 3]]))
    writers.write_lines(writers.intent_lines(intents, 2, 2), str(tmp_path / "i"))
    back = text.scan_intents(spark, str(tmp_path / "i"), 2)
    assert {tuple(r.grades) for r in back.collect()} == {tuple(r.grades) for r in intents.collect()}
    assert document(tmp_path / "i").startswith("2 2 26\nI ")


def lattice(make, rows):
    closure = ModalClosure(make(rows))
    concepts = en.concepts(closure.ctx, closure)
    ranked = writers.ranked_concepts(concepts, closure.m)
    ids = {r.mask: r.rank for r in ranked.collect()}
    pairs = [(ids[r.mask], ids[r.sup_mask]) for r in containment.modal_covers(concepts, closure).collect()]
    return closure.ctx, ranked, ranked.sparkSession.createDataFrame(pairs, "child bigint, parent bigint")


def test_concept_documents(make, tmp_path):
    ctx, ranked, edges = lattice(make, [[3, 7], [9, 4]])
    writers.write_lines(writers.hasse_lines(ranked), str(tmp_path / "h"))
    assert document(tmp_path / "h") == "{},\n{a1},\n{a1, a2},\n{a2},\n"
    writers.write_lines(writers.concept_lines(ranked, ctx), str(tmp_path / "full"))
    assert document(tmp_path / "full").split("\n\n")[2] == (
        "FDMConcept 3:\nAttributes: {a1, a2}\nObjects:\n  o1: 0.7\n  o2: 0.9")
    writers.write_lines(writers.dot_undirected(ranked, edges), str(tmp_path / "dot"))
    assert document(tmp_path / "dot") == (
        'graph Hasse {\nrankdir=BT;\nnode [shape=box];\n0 [label="{}"];\n1 [label="{1}"];\n2 [label="{1,2}"];\n'
        '3 [label="{2}"];\n0 -- 1;\n0 -- 3;\n1 -- 2;\n3 -- 2;\n}\n')
    writers.write_lines(writers.dot_directed(edges), str(tmp_path / "dir"))
    assert document(tmp_path / "dir").splitlines()[3] == "    0 -> 1;"
    writers.write_lines(writers.edge_lines(edges), str(tmp_path / "edges"))
    assert document(tmp_path / "edges") == "0 1\n0 3\n1 2\n3 2\n"


def test_index_document(spark, tmp_path):
    intents = spark.createDataFrame([(0, [8, 0, 10])], "id bigint, grades array<int>")
    writers.write_lines(writers.index_lines(intents), str(tmp_path / "x"))
    assert document(tmp_path / "x").splitlines()[2] == "0  0.8/0  1/2"


def test_metrics_log(spark, tmp_path):
    vertices = spark.createDataFrame([(0,), (1,)], "id bigint")
    edges = spark.createDataFrame([(0, 1)], "child bigint, parent bigint")
    writers.write_metrics(metrics.lattice_metrics(vertices, edges), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).first().height == 2


def test_random_context_is_seeded(spark):
    a, b = (text.random_context(spark, 50, 6, seed=3) for _ in range(2))
    assert cells(a) == cells(b)
    levels = {q for g in cells(a).values() for q in g}
    assert levels <= set(range(1, 10)) and len(levels) > 5
    assert a.frame.select(F.size("grades")).distinct().first()[0] == 6
