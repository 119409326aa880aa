import re

import duckdb
import pandas as pd

import corpus_pipeline
from tests.llm.test_operators import DOCS, SF, WORD, brute_components, documents, odd_documents, real_documents

COLUMNS = [c.split()[0] for c in DOCS.split(", ")]


def test_stages_against_brute_force(spark):
    from tessera.llm.mixing import mix

    rows = real_documents(spark)
    docs = documents(spark, rows)
    first = corpus_pipeline.quality(spark, docs, "")
    kept = [(r.doc_id, r.text, r.source) for r in first.collect()]
    assert 0 < len(kept) < len(rows) and first.columns == COLUMNS
    second = corpus_pipeline.near_duplicates(spark, first, "")
    left = sorted(r.doc_id for r in second.collect())
    assert left == sorted(int(i) for i, _, c in brute_components(kept) if i == c)
    want = sorted(r.doc_id for r in mix(spark, second).collect() for _ in range(r.copies))
    third = corpus_pipeline.mixing(spark, second, "")
    assert sorted(r.doc_id for r in third.collect()) == want and third.columns == COLUMNS
    last = corpus_pipeline.sentencepiece(spark, third, "").collect()
    assert sorted(r.doc_id for r in last) == want and all(r.round_trip for r in last)


def plain_lines(text):
    """The text without the lines that fail, by the rules as the docstrings of the quality rules state them."""
    from tessera.llm.quality import BOILERPLATE

    def fails(line):
        w = WORD.findall(line)
        return bool(w) and (not re.search("[.!?…。！？؟।]", line) or 2 * sum(c in "#*$%&|<>" for c in line) > len(w)
                            or sum(x in ("|", "·", "•", "»", "›", "→", "/") for x in w) >= 3
                            or len(w) <= 25 and any(p in line.lower() for p in BOILERPLATE))

    return "\n".join(line for line in text.split("\n") if not fails(line))


def lattice(text, v):
    """The best segmentation of a whole text from the full lattice."""
    best, frm = [0.0] + [float("-inf")] * len(text), [0] * (len(text) + 1)
    for e in range(1, len(text) + 1):
        for r in range(max(0, e - v.longest), e):
            s = v.score.get(text[r:e])
            if s is not None and best[r] + s > best[e]:
                best[e], frm[e] = best[r] + s, r
        if text[e - 1] not in v.score and best[e - 1] + v.unknown > best[e]:
            best[e], frm[e] = best[e - 1] + v.unknown, e - 1
    out, e = [], len(text)
    while e:
        piece = text[frm[e]:e]
        out.extend([v.id[piece]] if piece in v.id else reversed(v.fallback(piece)))
        e = frm[e]
    return out[::-1]


def test_run_against_brute_force(spark):
    """Every stage again outside Spark: counts of quality and mixing by DuckDB, lines, all pairs and lattice in Python."""
    from tessera.llm.mixing import OP7_SQL
    from tessera.llm.pieces import SPACE, Pieces, read_model
    from tessera.llm.quality import OP6_SQL

    rows = real_documents(spark)
    assert len({i for i, _, _ in rows}) == len(rows)

    def by_sql(sql, rows):
        c = duckdb.connect()
        frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
        c.register("documents", frame)
        return c.execute(sql).df()

    kept = by_sql(OP6_SQL, rows)
    kept = set(kept[kept["kept"]]["doc_id"])
    clean = [(i, plain_lines(t), s) for i, t, s in rows if i in kept]
    firsts = {int(i) for i, _, c in brute_components(clean) if i == c}
    left = [r for r in clean if r[0] in firsts]
    took = by_sql(OP7_SQL, left)
    copies = {int(i): int(n // size) for i, size, n in zip(took["doc_id"], took["size"], took["taken"], strict=True) if n}
    v, expected = Pieces.load(read_model()), []
    for i, text, _ in left:
        if i in copies:
            marks = [lattice(part.replace(" ", SPACE), v) for part in text.split(SPACE)]
            ids = marks[0]
            for more in marks[1:]:
                ids = ids + v.fallback(SPACE) + more
            expected += [(i, ids)] * copies[i]
    found = corpus_pipeline.run(spark, SF).collect()
    assert all(r.round_trip and len(r.ids) == r.n_ids for r in found)
    assert sorted((r.doc_id, list(r.ids)) for r in found) == sorted(expected) and 0 < len(left) < len(clean) < len(rows)


def test_odd_and_empty_tables(spark):
    for rows in (odd_documents(), []):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            docs.collect()
