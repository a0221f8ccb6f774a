import datetime as dt
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kinloom.llm import language, leakage, packing, survivor

ITEM = "The review board of Tamsil_89 shows for Vendris a clear gap between genuine and impostor scores because the threshold search of Joror_96 gives for Fenmo the same answer on both machines with 5351 workers"
SHORT = "The offset table of Zeldan at step 8809: 4742 / 9180?"
WORDS = ITEM.split()


def table():
    others = [f"The review board of Name{i}x shows for Other{i}y a clear gap between genuine and impostor scores with {i}77 workers" for i in range(12)]
    return leakage.ItemTable([1, 2, *range(10, 22)], [ITEM, SHORT, *others])


def told(t, text):
    return [n for _, n in t.leaked([text])]


def leaked(text):
    return told(TABLE, text)


TABLE = table()


def test_exact_spans_at_the_border():
    assert leaked("Intro words here " + " ".join(WORDS[3:16]) + " more") == [1]
    assert leaked("Intro words here " + " ".join(WORDS[3:15]) + " more") == []
    assert leaked(f"x {SHORT} y") == [2] and leaked("x " + SHORT[:-7]) == []
    assert leaked(None) == leaked("") == leaked("of the") == []


def test_layout_and_lettering_make_no_difference():
    span = WORDS[:16]
    for t in (" ".join(span).upper(), "\n> ".join(span), "​ ".join(span), " ".join(f"<b>{w}</b>" for w in span), "\xa0".join(span), " ".join(span).replace("o", "о").replace("a", "а"), "1) " + " ".join(span[:6]) + "\n2) " + " ".join(span[6:])):
        assert leaked("Before it. " + t) == [1], t
    assert leakage.plain_words("Đọc chỉ ĐÂY, naïve") == ["doc", "chi", "day", "naive"]


def test_near_spans_need_names_and_few_changes():
    w = WORDS[:]
    w[3], w[9], w[17] = "board,", "wide", "really"
    changed = [*w[:12], "also", *w[12:]]
    assert leaked(" ".join(changed)) == [1]
    assert leaked(" ".join(x if i % 5 else "other" for i, x in enumerate(WORDS))) == []
    named = WORDS[:]
    # the words between the names are a set phrase of 13 words, so one of them differs too
    named[4], named[7], named[12], named[21], named[24] = "Duvar_12", "Lomo", "plain", "Kelpeth", "Rosgast"
    assert leaked(" ".join(named[:26])) == []


def test_leak_operator_blocks_and_repeats(spark):
    docs = spark.createDataFrame([(1, "x " + ITEM), (2, "x " + ITEM), (3, None), (4, "nothing " * 9000), (5, SHORT)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, SHORT), (3, None), (4, ""), (7, ITEM)], "item_id long, text string")
    for block_words in (20, leakage.BLOCK_WORDS):
        got = {tuple(r) for r in leakage.leaked_items(docs, items, block_words=block_words).collect()}
        assert got == {(1, 1), (1, 7), (2, 1), (2, 7), (5, 2)}
    assert leakage.leaked_items(docs, items.limit(0)).count() == 0


def test_near_spans_do_not_depend_on_the_other_items():
    plain = "we walked along the quiet river until evening came and then sat under an old willow while the children sang songs about the distant sea"
    changed = plain.replace("quiet", "calm").replace("then", "later").replace("children", "others")
    assert len(plain.split()) == 25
    # alone every word stands in few items; repeated, in many
    for copies in (1, 3, 9):
        t = leakage.ItemTable(list(range(copies + 1)), [plain] * copies + ["short item here"])
        assert told(t, "Intro. " + changed + " end") == list(range(copies)), copies
        assert told(t, "Intro. " + " ".join(plain.split()[:12]) + " end") == []
    # a number may not be replaced
    numbered = " ".join([*plain.split()[:13], "5351", *plain.split()[13:]])
    t = leakage.ItemTable([1], [numbered])
    assert told(t, numbered.replace("quiet", "calm").replace("5351", "5352")) == told(t, numbered.replace("quiet", "calm").replace("sat", "lay").replace("5351", "")) == []


def test_every_near_passage_keeps_a_seed():
    rnd = random.Random(4)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    for n in (24, 25, 31, 32, 39, 40, 48, 60):
        for _ in range(40):
            item = rnd.sample(words, 90)
            at = rnd.randrange(90 - n + 1)
            part = item[at : at + n]
            for i in rnd.sample(range(1, n - 1), n // 8):
                part[i] = "else"
            t = leakage.ItemTable([1], [" ".join(item)])
            w = np.array([-1] * 60 + [t.vocab.get(x, -1) for x in part] + [-1] * 60)
            place, which, spot, picked = t.hits(w)
            seed = t.dense(place, which, spot, len(w)) & picked
            assert t.possible(w, place[seed], which[seed], spot[seed]).any(), (n, part)


EN = "the record writer keeps fewer images than the log suggests and the review board shows a clear gap between the scores of the two machines"
DE = "der datensatzschreiber behält weniger bilder als das protokoll vermuten lässt und die prüferin zeigt einen klaren abstand zwischen den paaren"
RU = "таблица меток показывает ясный разрыв между своими и чужими парами начиная с этой версии"


def model():
    return language.ContextTrees({"en": Counter(EN.split()), "de": Counter(DE.split()), "ru": Counter(RU.split())})


def test_segments_and_code():
    m = model()
    text = f"{EN}.\n\n{DE}. {DE}.\n```\nfor x in range(9): print(x)\n```\n{RU}."
    s = language.segments(m, text)
    assert [x[2] for x in s] == ["en", "de", "ru"] and all(x[3] > 0.99 for x in s)
    assert text[s[1][0] : s[1][1]].startswith("der") and text[s[2][0] :].startswith("таблица")
    assert language.segments(m, None) == language.segments(m, "") == language.segments(m, "```\nthe code\n```\n| a | b |\nstep=4 loss=0.1 12:30") == []
    assert [x[2] for x in language.segments(m, DE.upper() + "! " + DE.replace("ä", "a"))] == ["de"]
    # brute force of method C for one word under one language
    words = Counter(EN.split())
    nodes: dict[bytes, Counter] = {}
    for w, n in words.items():
        b = f" {w} ".encode()
        for i in range(1, len(b)):
            for o in range(min(language.ORDER, i) + 1):
                nodes.setdefault(b[i - o : i], Counter())[b[i]] += n
    for w in ("record", "recorded", "zq"):
        b, bits = f" {w} ".encode(), 0.0
        for i in range(1, len(b)):
            for o in range(min(language.ORDER, i), -1, -1):
                node = nodes.get(b[i - o : i])
                if not node:
                    continue
                total = sum(node.values()) + len(node)
                if node[b[i]]:
                    bits -= math.log2(node[b[i]] / total)
                    break
                bits -= math.log2(len(node) / total)
            else:
                bits += 8
        assert abs(m.bits([w])[0][language.LANGUAGES.index("en")] - bits) < 1e-9


def test_labels():
    assert [language.label_code(x) for x in ("en-US", "ENG", " Deutsch", "pt_BR", "und", "??", "", None, "it")] == ["en", "en", "de", "pt", None, None, None, None, "it"]


def test_language_operator(spark):
    rows = [(i, f"{EN} {i}" if i % 2 else f"{DE} {i}", "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, EN, "de"), (101, DE, None), (102, f"{EN}. {DE}.", "en"), (103, None, "en"), (104, "4 5 6", "en"), (105, EN, "EN-gb"), (106, EN * 400, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.labelled_sample(df, "doc_id", "text", "lang", 10)
    assert Counter(x for x, _ in sample)["en"] <= 10
    bad = {tuple(r) for r in language.wrong_labels(language.language_segments(df, language.fitted(sample))).collect()}
    assert bad == {(100, "en"), (101, "de"), (102, "en"), (102, "de")}


def test_packing_keeps_everything_within_capacity(spark):
    sizes = [1, 1, 3, 7, 10, 11, 50, 51, 99, 100, 101, 250, 33, 34, 49, 60, 60, 60, 5, 5, 5, 5, 5, 5] * 5
    df = spark.createDataFrame(list(enumerate(sizes)) + [(0, 1), (0, 1)], "item_id long, n_tokens int")
    for part_rows in (20, 50_000):
        p = packing.packed(df, 100, part_rows)
        rows = p.collect()
        assert sum(r.size for r in rows) == sum(sizes) + 2
        assert max(r.n_tokens for r in packing.containers(p, 100).collect()) <= 100
        assert {r.item_id for r in packing.split_items(p).collect()} == {i for i, s in enumerate(sizes) if s > 100}
    used = packing.containers(packing.packed(df, 100), 100)
    assert used.agg(F.sum("n_tokens") / F.count("*")).first()[0] > 75
    assert packing.packed(df.limit(0), 100).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "x" * 100_000), (1, "a b")], "doc_id long, text string")
    got = sorted(tuple(r) for r in packing.token_counts(df).collect())
    assert got[0] == got[1] == (1, 2) and got[2][0] == 4 and len(got) == 3


def test_survivors(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        (1, 10, "Ann Lo", 1980, "aldor", 5, "k1", t, 1),
        (1, 11, "n/a", 0, None, None, " ", None, 2),
        (2, 20, "Bo", 1980, None, 1, "k", t, 1),
        (2, 21, "Bo", None, "corvia", 1, "k", t + dt.timedelta(1), 1),
        (3, 30, "Cy", 1980, "a", 1, "k", t, 1),
        (3, 31, "Cy", 1980, "a", 1, "k", t, 1),
        (4, 40, "Di", 1980, "a", 1, "k", t, 2),
        (4, 41, None, None, None, None, None, None, 1),
        (5, 50, "Ed", 1980, "a", 1, "k", t, 1),
    ]
    df = spark.createDataFrame(rows, "group_id long, rec_id long, name string, birth_year int, country string, img_count long, best_img_key string, updated_at timestamp, trust_rank int")
    rules = survivor.filled_fields()
    m = survivor.with_fill(df, rules)
    assert [(r.group_id, r.rec_id) for r in survivor.unbeaten(m, list(rules)).collect()] == [(1, 10)]
    built = {r.group_id: r for r in survivor.built_records(m, list(rules)).collect()}
    assert (built[2].birth_year, built[2].country, built[2].lead_rec_id) == (1980, "corvia", 21)
    assert built[1].n_members == 2 and built[4].name == "Di"
    assert survivor.leaders(m).count() == 5


def test_clashing_extra_columns(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 10, "Ann", 1980, "a", 5, "k", t, 1), (1, 11, None, None, None, None, None, None, 2)], "group_id long, rec_id long, name string, birth_year int, country string, img_count long, best_img_key string, updated_at timestamp, trust_rank int")
    extra = df.select("*", *[F.lit(3).alias(c) for c in ("salt", "no", "n_members", "last", "any_has", "best_trust")])
    rules = survivor.filled_fields()
    m = survivor.with_fill(extra, rules)
    assert [r.rec_id for r in survivor.unbeaten(m, list(rules)).collect()] == [10] and survivor.leaders(m).first()["no"] == 3
    docs = spark.createDataFrame([(1, ITEM, "en", 1, 2)], "doc_id long, text string, lang string, item_id int, label int")
    items = spark.createDataFrame([(1, ITEM, 5)], "item_id long, text string, doc_id int")
    assert [tuple(r) for r in leakage.leaked_items(docs, items).collect()] == [(1, 1)]
    assert language.language_segments(docs, {"en": Counter(EN.split()), "de": Counter(DE.split())}).count() == 1
    assert packing.token_counts(docs.withColumn("n_tokens", F.lit(1))).count() == 1
