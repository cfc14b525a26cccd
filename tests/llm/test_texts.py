import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from taleflow.llm import cross_split, leakage, mixing, residue, turns
from taleflow.llm.normalise import words


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p = [i]
        for j, y in enumerate(b, 1):
            p.append(min(d[j] + 1, p[-1] + 1, d[j - 1] + (x != y)))
        d = p
    return d[-1]


def test_words():
    assert words("Så <b>K&aelig;ld&shy;er</b> SÃ¦be å ø") == ["saa", "b", "kaelder", "b", "saebe", "aa", "oe"]
    assert words(None) == words("") == words(" .,-_ ") == []


FORMATS = [
    "Udskrift\n[00:00:02] A: ja øh tak\n[00:00:05] Taler 2: det er (griner) rigtigt\n[00:00:07] b: [00:00:08] jeg\n  ved det\n[00:00:07] b: [00:00:08] jeg ved det\n[00:00:09] Begge: hov\n[00:00:10] ?: x\n[00:00:12] spk1: *** mm,\n[00:00:13] a: okay {musik}",
    "1\r\n00:00:02,000 --> 00:00:03,000\r\nA: ja øh tak\r\n\r\n2\r\n00:00:05,000 --> 00:00:06,500\r\nspk2: det er <latter> rigtigt\r\n\r\n3\r\n00:00:07,000 --> 00:00:08,000\r\nB.: jeg\r\n  ved det\r\n\r\n4\r\n00:00:13,000 --> 00:00:14,000\r\nTALER A: okay",
    "WEBVTT\n\n00:00:05.000 --> 00:00:06.500\n<v taler_b>det er #pause# rigtigt\n\n00:00:02.000 --> 00:00:03.000\n<v A>ja tak hmm\n\n00:00:07.000 --> 00:00:08.000\n<v Person B>jeg ved det\n\n00:00:13.000 --> 00:00:14.000\n<v T1>okay</v>",
    " A  (00:02) ja tak\nTaler 2 (00:05) det er ***uklart*** rigtigt\nB (00:07) jeg ved\n  det\nA+B (00:08) nej\nA (00:13) okay",
    "[Script Info]\nFormat: x\nDialogue: 0,0:00:02.00,0:00:03.00,Default,A,0,0,0,,ja, tak\nDialogue: 0,0:00:05.00,0:00:06.00,Default,B,0,0,0,,{\\i1}det er{\\i0} rigtigt\nDialogue: 0,0:00:07.00,0:00:08.00,Default,b,0,0,0,,jeg ved det\nDialogue: 0,0:00:13.00,0:00:14.00,Default,Spk A,0,0,0,,okay",
    "(2,0–3,5 s) A – ja tak\n(5,0–6,0 s) B – det er rigtigt\n(7,0–8,0 s) Speaker B – jeg ved det\n(13,0–14,0 s) Taler  a – okay",
    "2000\t3000\tA\tja tak\n5000\t6000\tB\tdet er rigtigt\n7000\t8000\t B \tjeg ved det\n13000\t14000\tT1\tokay",
]


def test_turns_in_every_format(spark):
    rows = [(f" Con_{i}", 1, t) for i, t in enumerate(FORMATS)] + [(f"con_{i}", 2, t) for i, t in enumerate(FORMATS)]
    rows += [("con_e", 1, ""), ("con_n", 1, None), (None, 1, FORMATS[0]), ("con_h", 1, "ingen tid her\nA: nej"), rows[0]]
    df = spark.createDataFrame(rows, "id_conversation string, chunk_no int, text string").withColumns({"speaker": F.lit(1), "line": F.lit("x"), "doc": F.lit(2)})
    got = {}
    for r in turns.speaker_turns(df).collect():
        got.setdefault(r.id_conversation, {})[r.turn_no] = (r.speaker, r.n_words)
    assert got == {f"con_{i}": {1: ("A", 2), 2: ("B", 6), 3: ("A", 1)} for i in range(len(FORMATS))}
    assert turns.speaker_turns(df.limit(0)).collect() == []
    assert {r.text for r in turns.turn_texts(df).filter("turn_no = 2").collect()} == {"det er rigtigt jeg ved det"}


def test_turn_numbers_across_blocks(spark):
    rng = random.Random(3)
    lines = [("c", t, None, 1, t, rng.choice("AB"), "x", ["x"]) for t in sorted(rng.sample(range(5000), 200))]
    df = spark.createDataFrame(lines + lines[:9], "id_conversation string, start_ms long, end_ms long, chunk_no int, line_no int, speaker string, text string, words array<string>")
    want, n, last = Counter(), 0, None
    for x in lines:
        n += x[5] != last
        last = x[5]
        want[n, x[5]] += 1
    for block in (7, 100, 100_000):
        pieces = turns.turn_pieces(df, block, {}, {"n": F.sum("n")})
        got = Counter()
        for r in turns.number_turns(pieces).collect():
            got[r.turn_no, r.speaker] += r.n
        assert got == want


def test_segments_cover():
    for n in range(4, 40):
        cut = cross_split.segments(n)
        assert cut[0][0] == 0 and sum(x for _, x in cut) == n and all(x > 0 for _, x in cut)


def test_rest_segments_cover():
    for n in range(4, 60):
        cut = cross_split.segments(n)
        for i, (p, length) in enumerate(cut):
            parts = cross_split.rest_segments(n, i)
            if not parts:
                assert n - length < len(cut)
                continue
            covered = [x for s, k, _ in parts for x in range(s, s + k)]
            assert len(parts) == len(cut) and all(k > 0 for _, k, _ in parts) and len(covered) == len(set(covered))
            assert not set(covered) & set(range(p, p + length)) and all((s < p) == before for s, _, before in parts)


def test_overlaps_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"ord{i}" for i in range(60)] + ["øre", "<UNK>", "aften"]
    rows, base = [], []
    for i in range(500):
        if base and rng.random() < 0.7:
            ws = list(rng.choice(base))
            for _ in range(rng.randrange(0, 5)):
                p, kind = rng.randrange(len(ws) + 1), rng.randrange(3)
                ws[p : p + (kind > 0)] = [rng.choice(vocabulary)] if kind < 2 else []
        else:
            ws = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 26))]
            base.append(ws)
        t = " ".join(ws)
        t = rng.choice([t, t.upper(), t.replace("ø", "oe") + " .", "  ".join(ws), "- " + t])
        rows.append((f"r{i:04d}", rng.choice(["train", "Training", "test_x", "VAL ", "dev", "other"]), t if i % 2 else None, None if i % 2 else t))
    rows += [("z1", "train", None, None), (None, "test", "a b c d e", None), ("z2", "train", "a b c d e", None), ("z3", None, "a b c d e", None), ("z4", "test", "", "a b c d e"), rows[0]]
    df = spark.createDataFrame(rows, "id_recording string, split string, text string, sentence string").withColumns({"source": F.lit("s"), "words": F.lit(1), "n": F.lit(1), "code": F.lit(2)})
    got = [tuple(r) for r in cross_split.overlapping_pairs(df).collect()]
    of = {}
    for i, s, a, b in rows:
        k = (s or "").strip().lower()
        role = "t" if k.startswith("train") else "e" if k.startswith(("val", "dev", "test")) else None
        ws = words(a if a is not None else b)
        if i and role and len(ws) >= 4:
            of[i] = (role, ws)
    want = {tuple(sorted((i, j))) for i, (r, x) in of.items() for j, (q, y) in of.items() if r == "e" and q == "t" and distance(x, y) * 6 <= max(len(x), len(y))}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    # every block hot, and some of them
    for hot in (1, 4):
        assert {tuple(r) for r in cross_split.overlapping_pairs(df, hot).collect()} == want
    report = cross_split.overlap_report(df)
    assert report.agg(F.sum("n_pairs")).first()[0] == len(want)
    assert cross_split.overlapping_pairs(df.limit(0)).collect() == []


def test_myers():
    rng = random.Random(8)
    for _ in range(150):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        best = min(distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert leakage.myers(p, t, 3) == min(best, 4)


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    w = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(w) for _ in range(rng.randrange(8, 30))), "s", "test") for i in range(40)] + [(99, None, None, None), (98, "", None, None)]
    docs = []
    for i in range(200):
        ws = [rng.choice(w) for _ in range(rng.randrange(0, 60))]
        if i % 2:
            src = items[rng.randrange(40)][1].split()
            n = rng.randrange(6, 16)
            a = rng.randrange(max(1, len(src) - n))
            ws[5:5] = src[a : a + n]
        docs.append((i, rng.choice([" ", "\n", ", "]).join(ws).replace("w1", "W\xad1")))
    docs += [(500, None), (501, ""), (None, items[0][1]), docs[1]]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(7), "edits": F.lit(1)})
    it = spark.createDataFrame(items, "item_id long, text string, source string, split string")
    want = set()
    for i, t in docs:
        x = " " + " ".join(words(t)) + " "
        want |= {(i, k) for k, s, *_ in items if s and i is not None for ws in [words(s)] for a in range(len(ws) - 9) if " " + " ".join(ws[a : a + 10]) + " " in x}
    got = [tuple(r) for r in leakage.leaking_documents(d, it).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
    assert {tuple(r)[:2] for r in leakage.leaked_passages(d, it, 10, 0, pass_letters=900).collect()} == want
    assert {tuple(r)[:2] for r in leakage.leaked_passages(d, it, 10, 0, part_letters=70).collect()} == want
    assert {tuple(r) for r in leakage.leaked_passages(d, it, 10, 2, 900, 70).collect()} == {tuple(r) for r in leakage.leaked_passages(d, it, 10, 2).collect()}
    # an item given again with another text is searched with both
    twice = it.union(spark.createDataFrame([(0, items[1][1], "s", "test")], it.schema))
    assert {r.item_id for r in leakage.leaked_passages(d, twice, 10, 0).collect() if (r.doc_id, 1) in want} >= {0, 1} & {k for _, k in want}
    near = {tuple(r)[:2] for r in leakage.leaked_passages(d, it, 10, 2).collect()}
    assert want <= near
    assert leakage.leaking_documents(d, it.limit(0)).collect() == [] == leakage.leaking_documents(d.limit(0), it).collect()
    pieces = leakage.Pieces([(1, items[0][1].split())], 8, 1)
    pieces.automaton, with_automaton = None, pieces.hits(" " + items[0][1] + " ")
    assert sorted(with_automaton) == sorted(pieces.hits(" " + items[0][1] + " "))


def test_every_passage_within_the_errors_is_found():
    rng = random.Random(4)
    ws = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 6))) for _ in range(12)]

    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    passage = [f"w{i}" for i in range(1, 11)]
    joined = leakage.Pieces([(1, passage)], 10, 2)
    assert leakage.leaks_of("w1 w2 w3w4 w5 w6w7 w8 w9 w10".split(), joined, 10, 2) == {1: 2}
    assert leakage.leaks_of("w1 w2 w3xw4 w5 w6 w7 w8 w9 v10".split(), joined, 10, 2) == {1: 2}
    for errors in (0, 1, 2, 3, 11):
        pieces = leakage.Pieces([(1, ws)], 10, errors)
        passages = [" " + " ".join(ws[i : i + 10]) + " " for i in range(3)]
        blanks = [i for i, c in enumerate(passages[1]) if c == " "]
        for trial in range(60):
            t = list(passages[1])
            for at in rng.sample(blanks if trial % 2 else range(len(t)), min(rng.randrange(errors + 2), 5)):
                t[at] = rng.choice(["", "x", t[at] + "y"])
            found = "".join(t).split()
            text = " " + " ".join(found) + " "
            want = min(least(p, text) for p in passages)
            assert leakage.leaks_of(found, pieces, 10, errors) == ({1: want} if want <= errors else {})
            automaton, pieces.automaton = pieces.automaton, None
            assert leakage.leaks_of(found, pieces, 10, errors) == ({1: want} if want <= errors else {})
            pieces.automaton = automaton


def deviation(plan, frame):
    """Greatest distance, in slots, of a source from its share at any slot of the schedule."""
    rows = sorted(plan_rows(plan, frame), key=lambda r: r[2])
    assert [r[2] for r in rows] == list(range(len(rows)))
    total, given, worst = sum(w for _, w, _ in plan), Counter(), 0.0
    for source, block, slot in rows:
        assert block == given[source]
        given[source] += 1
        worst = max(worst, *(abs(given[s] - w / total * (slot + 1)) for s, w, _ in plan))
    return worst, len(rows)


def plan_rows(plan, frame):
    total = sum(w for _, w, _ in plan)
    weights = [w / total for _, w, _ in plan]
    cumulated = np.cumsum(weights)
    cumulated[-1] = 1.0
    length = mixing.frame_length(weights, frame)
    out = []
    for k in range(3):
        before = mixing.given_before(cumulated, k * length)
        counts = mixing.given_before(cumulated, (k + 1) * length) - before
        assert counts.min() >= 0 and counts.sum() == length
        out += [(plan[s][0], int(before[s]) + j, k * length + t) for t, (s, j) in enumerate(mixing.pfair(counts.tolist()))]
    return out


def test_pfair_deviation():
    rng = random.Random(5)
    cases = [[0.5, 0.3, 0.15, 0.05], [1 / 3, 2 / 3], [1.0], [0.9, 0.0501, 0.0499]] + [[rng.random() + 0.01 for _ in range(rng.randrange(2, 25))] for _ in range(12)]
    for weights in cases:
        for frame in (10, 60):
            worst, n = deviation([(f"s{i}", w, 0) for i, w in enumerate(weights)], frame)
            assert worst < 2 and n >= 30  # two slots are one block
    for counts in ([3, 1, 0, 7], [1] * 20, [50, 1], [0, 4]):
        n, seen = sum(counts), Counter()
        for t, (s, j) in enumerate(mixing.pfair(counts)):
            assert j * n // counts[s] <= t < -(-(j + 1) * n // counts[s]) and seen[s] == j
            seen[s] += 1


def test_any_number_of_sources_and_small_weights(spark):
    n = 1500
    d = spark.createDataFrame([(i, "a b c d " * 8, f"s{i % n}") for i in range(3 * n)], "doc_id long, text string, source string")
    t = spark.createDataFrame([(f"s{i}", 1e-5 if i == 3 else 1 / n, 2) for i in range(n)] + [("s1", None, None), ("rare", 1e-9, 1), ("none", 0.0, 1)], "source string, target_weight double, max_repeats int")
    rows = mixing.mix(d, t, block_tokens=16).collect()
    assert len({r.source for r in rows}) == n and len({(r.doc_id, r.repeat) for r in rows}) == len(rows)
    assert {r.source for r in mixing.short_sources(d, t).collect()} == {"rare"}
    rare = mixing.schedule(spark, [("a", 1.0, 50), ("b", 1e-7, 3)]).collect()
    assert sorted(r.block for r in rare if r.source == "b") == [0, 1, 2] and len([r for r in rare if r.source == "a"]) == 50


def test_token_counts_are_exact():
    import os

    from tokenizers import Tokenizer

    if not os.path.exists(mixing.TOKENIZER):
        return
    rng, count, t = random.Random(2), mixing.TokenCounter(mixing.TOKENIZER), Tokenizer.from_file(mixing.TOKENIZER)
    t.encode_special_tokens = True
    texts = ["".join(rng.choice(["ord", "Æble", " ", " ", "  ", "\n", "\t", "'s", "'", "1", "23", ".", ",", "<|endoftext|>", "é", "e\u0301", "😀", "\u00a0", "\u3000"]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    assert count(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_mix_shares(spark):
    rng = random.Random(11)
    docs = [(i, " ".join(["ord"] * rng.randrange(5, 40)), rng.choice(["big", "Big_da", "mid", "tiny"][: 3 + (i % 40 == 0)])) for i in range(1500)] + [(9001, None, "big"), (9002, "", "mid"), (9003, "a b c", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.45, 3), ("tiny", 0.04, 2), ("none", 0.01, 2)], "source string, target_weight double, max_repeats int")
    assert {r.source for r in mixing.short_sources(d, t).collect()} == {"tiny", "none"}
    rows = mixing.mix(d, t, block_tokens=64, buckets=4).collect()
    assert len({(r.doc_id, r.repeat) for r in rows}) == len(rows)
    report = {r.source: r for r in mixing.mix_report(d, t).collect()}
    assert report["none"].mixed_tokens == 0 and report["tiny"].mixed_tokens == 2 * report["tiny"].size
    for s in ("big", "mid"):
        assert 0 <= report[s].mixed_tokens - report[s].want < 60
    per = Counter()
    for r in rows:
        per[r.source, r.slot] += 1
    assert len({k[1] for k in per}) == len(per)  # one source per slot
    assert mixing.mix(d.limit(0), t).collect() == []


RESIDUE = [
    (1, "Titel: {{navn}} og mere tekst her i dag", True),
    (2, "HTTP 404 Not Found", True),
    (3, "Aktivér venligst JavaScript i din browser for at fortsætte.", True),
    (4, "Lorem ipsum dolor sit amet consectetur.", True),
    (5, 'I en skabelon skriver man for eksempel "{navn}", hvor værdien senere sættes ind.', False),
    (6, "Tegnfølgen `%navn%` kaldes en pladsholder, forklarede læreren.", False),
    (7, "[musik] Præsten sang <støj> i kirken {latter} hele aftenen.", False),
    (8, "Fejl 404 er den fejl, som bageren oftest hører om.", False),
    (9, "Præsten gik en lang tur i skoven med sin hund. " * 8 + "\nPlease enable JavaScript to continue.", False),
    (10, None, False),
    (11, "", False),
    (12, "Svar: __ja__ eller __nej__. Mængden {a, b, c} har tre elementer. Prisen var 40 $ eller mere, 12 % over.", False),
    (13, "Erstat denne tekst\nErstat denne tekst", True),
    (14, "Den røde mur\n502 | Adgang nægtet.", True),
    (15, "Der st&aring;r &lt;modtager&gt; i brevet til kongen", True),
]


def test_residue(spark):
    d = spark.createDataFrame([(i, t, "s") for i, t, _ in RESIDUE] + [(1, RESIDUE[0][1], "s")], "doc_id long, text string, source string").withColumns({"host": F.lit(1), "slot": F.lit(2), "line": F.lit("x")})
    got = [r.doc_id for r in residue.residual_documents(d).collect()]
    assert sorted(got) == [i for i, _, bad in RESIDUE if bad]
    assert residue.residual_documents(d.limit(0)).collect() == []


def test_boilerplate_is_subtracted(spark):
    footer = "Læs mere om vores gode avis og tegn abonnement i dag\nRing til os på hverdage\n"
    d = spark.createDataFrame([(i, footer + ("Siden blev ikke fundet" if i == 0 else f"Nyt nummer {'abcdefghijkl'[i]} om byens liv"), "avis") for i in range(12)], "doc_id long, text string, source string")
    assert [r.doc_id for r in residue.residual_documents(d).collect()] == [0]
    assert residue.residual_documents(d, recurrent=100).collect() == []
    # the same corpus several times over, under new ids, gives the same documents
    again = d.withColumn("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.col("doc_id") + 100 * i)))
    assert sorted(r.doc_id for r in residue.residual_documents(again).collect()) == [100 * i for i in range(8)]
    # the lines of another host are not boilerplate
    assert residue.residual_documents(d.withColumn("source", F.concat(F.lit("s"), F.col("doc_id").cast("string")))).collect() == []


def test_copies_make_no_line_recur(spark):
    full = "Præsten gik en lang tur i skoven med sin hund.\n" * 2 + "De så på fuglene ved søen hele dagen.\nPlease enable JavaScript to continue."
    copies = [(i, full if i % 3 else full.upper(), "avis") for i in range(30)]
    others = [(100 + i, f"Nyt nummer {'abcdefghijkl'[i]} om byens liv", "avis") for i in range(12)]
    d = spark.createDataFrame(copies + others, "doc_id long, text string, source string")
    assert residue.residual_documents(d).collect() == []


def test_recurrence_is_a_share_of_the_texts(spark):
    def lines(n, **kw):
        d = spark.createDataFrame([(i, f"nummer {'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100 % 10]}" + ("\nhvem der?" if i < 9 else ""), "avis") for i in range(n)], "doc_id long, text string, source string")
        read = residue.read_documents(d)
        wanted = read.select("host", F.explode("keys").alias("line")).distinct()
        return residue.recurrent_lines(read, wanted, **kw).count()

    assert lines(800, share=0.01) == 1
    assert lines(1000, share=0.01) == 0
    assert lines(800, share=0.01, recurrent=10) == 0


def test_long_text(spark):
    d = spark.createDataFrame([(1, "ord " * 300_000 + "{navn}", "s")], "doc_id long, text string, source string")
    it = spark.createDataFrame([(1, "ord " * 12, "s", "t")], "item_id long, text string, source string, split string")
    assert residue.residual_documents(d).count() == 1
    assert leakage.leaking_documents(d, it).count() == 1
