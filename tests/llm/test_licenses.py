import itertools
import random
import re

import duckdb

from tapeloom.llm.licenses import LICENSE_SQL, TEMPLATES, collision_probability, scanned, template_table

from .conftest import EDGES


def words_of(text):
    return re.split(r"[^a-z0-9\x80-\U0010FFFF]+", text.lower())


def shingles(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute(rows):
    best = {}
    for doc_id, text in rows:
        own = shingles(words_of(text or ""))
        for name, template in TEMPLATES:
            parts = set(shingles([w for w in words_of(template) if w]))
            n = len(parts)
            for i in range(len(own)):
                if parts.intersection(own[i : i + 2]):
                    share = len(parts.intersection(own[max(0, i - n + 1) : i + n + 1])) / n
                    if share >= 0.8:
                        best[doc_id, name] = max(share, best.get((doc_id, name), 0))
    return best


def test_against_brute_force(spark, docs_of):
    rng = random.Random(12)
    filler = [f"w{k}" for k in range(50)]
    rows = [*[(r[0], r[1]) for r in EDGES]]
    for k in range(100, 220):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 60))]
        notice = rng.choice(TEMPLATES)[1].split()
        if k % 3 == 0:
            notice[rng.randrange(len(notice))] = "CHANGED"
        if k % 7 == 0:
            notice = notice * 3
        at = rng.randint(0, len(words))
        rows.append((k, "\n".join([" ".join(words[:at]), " ".join(notice), " ".join(words[at:])])))
    docs = docs_of([(*r, "en", "a") for r in rows])
    got = {(r.doc_id, r.license): r.containment for r in scanned(docs, template_table(spark)).collect()}
    assert got == brute(rows) and len(got) > 60


def test_sql_on_notices_inside_texts(docs_of):
    """Every template at the start, in the middle and at the end of a text: the SQL finds what brute force finds."""
    forms = ("{} more words follow", "some words before. {} And more words follow", "words before {}", "{}")
    rows = [(k, form.format(text)) for k, (form, (_, text)) in enumerate(itertools.product(forms, TEMPLATES))]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {(k, name): 1.0 for k, name in enumerate([name for _ in forms for name, _ in TEMPLATES])}
    assert {(a, b): c for a, b, c in con.execute(LICENSE_SQL).fetchall()} == want
    assert brute(rows) == want


def test_nothing(spark, nothing, edges):
    assert scanned(nothing, template_table(spark)).count() == 0
    assert scanned(edges, template_table(spark).limit(0)).count() == 0
    assert scanned(edges, spark.createDataFrame([("short", "four words are few"), ("null", None)], "license string, text string")).count() == 0


def test_bands_guarantee_collisions():
    assert collision_probability(0.5) > 0.99 and collision_probability(0.0) == 0 and collision_probability(1.0) == 1
