import random

import pytest
from pyspark.sql import functions as F

from reelspark.llm import mixing, packing, spam
from reelspark.llm.tokens import with_token_counts
from tests.conftest import rows

SIZES = "doc_id bigint, doc_tokens bigint, grp string, row string"


def test_token_counts_of_all_vocabularies(spark):
    texts = [None, "", "hello world", "xin chào các bạn", "<|endoftext|>", "a" * 20_000, " ".join(["từ"] * 20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("tokens_", F.lit("x"))
    for name in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"):
        got = {r["doc_id"]: r["tokens"] for r in with_token_counts(df, tokenizer=f"/opt/tokenizers/{name}").collect()}
        assert got[0] == got[1] == 0 and got[2] in (2, 3) and got[4] > 1 and got[6] >= 20_000
    same = [with_token_counts(df, tokenizer=f"/opt/tokenizers/byte_bpe_50k.{k}") for k in ("tiktoken", "json")]
    assert rows(same[0]) == rows(same[1])


def test_bounds_hold_and_best_fit_is_valid():
    rnd = random.Random(1)
    for _ in range(200):
        c = rnd.randrange(5, 60)
        sizes = sorted((rnd.randrange(1, c + 1) for _ in range(rnd.randrange(1, 40))), reverse=True)
        import numpy as np

        bins = packing.best_fit(np.array(sizes), c)
        used = {}
        for b, s in zip(bins, sizes):
            used[b] = used.get(b, 0) + s
        assert max(used.values()) <= c and sorted(used) == list(range(len(used)))
        bound = packing.lower_bound(np.array(sizes), c)
        assert -(-sum(sizes) // c) <= bound <= len(used)
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3 and packing.lower_bound(np.array([4, 4, 4, 4]), 10) == 2
    assert packing.lower_bound(np.array([], int), 10) == 0
    # Counts stand for repeated sizes, also for far more of them than memory holds.
    assert packing.lower_bound(np.array([6, 3]), 10, np.array([3, 2])) == packing.lower_bound(np.array([6, 6, 6, 3, 3]), 10)
    assert packing.lower_bound(np.array([5, 10]), 10, np.array([10**15, 7])) == 10**15 // 2 + 7


def test_packing_keeps_every_item_once(spark):
    rnd = random.Random(2)
    data = [(rnd.choice([None, i]), rnd.choice([None, 0, -3, 100, 101, 250, rnd.randrange(1, 100)]), "x", "y") for i in range(1500)]
    data += data[:300]
    df = spark.createDataFrame(data, SIZES)
    packed = packing.pack(df, [(1, 100), (2, 100_000), (None, 5), (3, None)], group_items=200)
    for i, c in ((1, 100), (2, 100_000)):
        mine = packed.where(F.col("capacity_id") == i)
        assert mine.agg(F.sum("part_tokens")).collect()[0][0] == sum(n for _, n, *_ in data if n and n > 0)
        per_doc = mine.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("part_tokens").alias("t"))
        want = {}
        for d, n, *_ in data:
            if d is not None and n and n > 0:
                want.setdefault(d, []).append(n)
        assert {r["doc_id"]: (r["n"], r["t"]) for r in per_doc.collect()} == {d: (sum(-(-n // c) for n in v), sum(v)) for d, v in want.items()}
        boxes = packing.containers(mine)
        assert boxes.where("used_tokens > capacity or unused_tokens < 0").isEmpty()
        bound = packing.bounds(mine)[i]
        assert bound <= boxes.count() <= bound * 1.03 + 1
    assert rows(packing.pack(df.limit(0), [(1, 10)])) == []
    with pytest.raises(ValueError):
        packing.pack(df, [])


def test_gaps_are_repacked(spark):
    # Half the capacity plus one never pairs; thirds do: small groups leave gaps that a pool closes.
    data = [(i, 34 if i % 3 else 32, "x", "y") for i in range(120)]
    packed = packing.pack(spark.createDataFrame(data, SIZES), [(1, 100)], group_items=7)
    once = packing.pack(spark.createDataFrame(data, SIZES), [(1, 100)], group_items=7, exchange=False)
    n, before = packing.containers(packed).count(), packing.containers(once).count()
    assert packing.bounds(packed)[1] <= n < before


DOCS = "doc_id bigint, source string, tokens bigint, budget string, h string"
TARGETS = "source string, target_share double, max_repeats int"


def test_mix_reaches_shares_and_nests(spark):
    rnd = random.Random(3)
    data = [(i, rnd.choice(["a", " A", "b-c", "B c", "d", None, "zz"]), rnd.choice([None, 0, rnd.randrange(1, 60)]), "x", "y") for i in range(6000)]
    docs = spark.createDataFrame(data, DOCS)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b_c", 0.3, 1), ("d", 0.1, 5), ("gone", 0.1, 1), (None, 0.3, 1)], TARGETS)
    mixed = mixing.mix(docs, targets, (0.3, 1.0))
    table = {(r["budget"], r["source"]): r for r in mixing.shares(mixed, docs, targets).collect()}
    for b in (0.3, 1.0):
        assert table[b, "gone"]["used_tokens"] == 0
        for s, share in (("a", 5 / 9), ("b_c", 3 / 9), ("d", 1 / 9)):
            r = table[b, s]
            assert abs(r["actual_share"] - share) < 0.003 and 0 < r["most_uses"] <= r["max_repeats"]
    assert any(abs(table[1.0, s]["used_tokens"] - table[1.0, s]["available_tokens"] * table[1.0, s]["max_repeats"]) < 60 for s in ("a", "b_c", "d"))
    uses = {(r["budget"], r["doc_id"]): r["uses"] for r in mixed.collect()}
    assert all(uses[1.0, d] >= n for (b, d), n in uses.items() if b == 0.3)
    assert mixed.select("doc_id", "budget").distinct().count() == mixed.count()


def test_mix_refines_only_until_single_documents(spark):
    data = [(i, "a", 10, "", "") for i in range(20_000)] + [(i, "b", 10, "", "") for i in range(50_000, 50_777)]
    docs = spark.createDataFrame(data, DOCS)
    mixed = mixing.mix(docs, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], TARGETS))
    used = dict(mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses"))).collect())
    assert used["b"] == 23_310 and abs(used["a"] - 23_310) <= 10


def test_a_large_document_does_not_end_a_source(spark):
    data = [(i, "a", 10, "", "") for i in range(3_000)] + [(i, "a", 6_000, "", "") for i in range(5_000, 5_003)] + [(i, "b", 10, "", "") for i in range(9_000, 10_200)]
    docs = spark.createDataFrame(data, DOCS)
    mixed = mixing.mix(docs, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS), (0.5, 1.0))
    used = {(r[0], r[1]): r[2] for r in mixed.groupBy("budget", "source").agg(F.sum(F.col("tokens") * F.col("uses"))).collect()}
    assert used[1.0, "b"] == 12_000 and abs(used[1.0, "a"] - 12_000) <= 10 and abs(used[0.5, "a"] - 6_000) <= 10
    # Beyond the small ones the large ones take part, whole.
    all_of_a = mixing.mix(docs, spark.createDataFrame([("a", 1.0, 2)], TARGETS), (0.5, 1.0)).where("budget = 1.0")
    assert rows(all_of_a.select("uses").distinct()) == [(2,)] and all_of_a.count() == 3_003


def test_mix_of_nothing(spark):
    docs, targets = spark.createDataFrame([(1, "a", 5, "", "")], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert rows(mixing.mix(docs.limit(0), targets)) == [] and rows(mixing.mix(docs, targets.limit(0))) == []
    assert rows(mixing.mix(docs, targets), "doc_id", "uses") == [(1, 1)]
    same = spark.createDataFrame([(None, "a", 5, "", "")] * 3 + [(1, "b", 3, "", "")] * 4, DOCS)
    both = mixing.mix(same, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS))
    assert {r[0] for r in both.select("source").distinct().collect()} <= {"a", "b"}


SPAM = {
    1: "cheap tickets live stream " * 30,
    2: "\n".join(f"https://site{i}.example.com/watch/{i}" for i in range(12)),
    3: "\n".join(f"go to film{i}(.)example(.)org slash v {i}" for i in range(9)),
    4: " ".join(f"#Live{i % 4} #Goal{i % 3}" for i in range(20)),
    5: " | ".join(f"tripod kit SKU{1000 + i} $1{i}.99 lens cap" for i in range(12)),
    6: "xem phim video hot giá rẻ miễn phí " * 25,
    7: "Match » Bulletin » Match (12) » Festival » Match » Festival (3) » Bulletin » Match » Festival » Bulletin » Match » Festival",
    8: "\n".join(f"full match tickets {c}" for c in ("Oakley", "Kesley", "Oakford", "Ulmley", "Lornness", "Oakley", "Brinley", "Kesley")),
}
HAM = {
    21: "The village choir opened the new school gate before sunrise, and a reporter told us that the ferry would return in nine days. Nobody expected the harvest to be so quiet.",
    22: "07:11 – Match quiet Lornley\n08:00 – Forecast muddy Fenwick\n09:24 – Exhibition noisy Kesham\n10:03 – Rescue narrow Holport\n11:16 – Parade foggy Oakmere",
    23: "Lights: Darstead unit 4\nCamera: Ulmness unit 6\nCamera: Calcombe unit 6\nLights: Marmere unit 6\nEditing: Ulmbury unit 7",
    24: "Norwick\t5–4\tLornstead\nCalcombe\t1–2\tRavham\nWexham\t6–6\tKesford",
    25: "EXIT\n26°C Lornley\nThe Scoreboard\nkm 171\ntemporary match\nMATCH HOLSTEAD\nan elderly potter paints a mobile clinic",
    26: "um you can see see see see the ferry on the left and the crew told us that they would stay at the harbour for nine more days before the show",
    27: "Nhóm quay phim đếm được 33 người quanh cổng trường sau tiếng còi, và trọng tài nói rằng trận đấu sẽ được xem lại vào buổi tối. Xem thêm: https://a.example/v/1",
}


WHO = ("a reporter", "the choir", "an old potter", "two riders", "the referee", "our crew")
DID = ("opened", "painted", "carried", "watched", "counted", "repaired")
WHAT = ("the gate", "a ferry", "the loom", "three baskets", "an old tram", "the radio mast")
WHEN = ("before it began to rain", "and then they all went home", "because nobody else would", "while we were on the way", "so that it could be seen from there", "after he had told us about it")
PROSE = {
    1_000 + i: " ".join(f"{WHO[(i + k) % 6].capitalize()} {DID[(i // 2 + k) % 6]} {WHAT[(i // 3 + 2 * k) % 6]} in {chr(65 + i % 26)}{'aeiou'[k]}ford {WHEN[(i // 5 + k) % 6]}." for k in range(4))
    for i in range(60)
}
LISTS = {2_000 + i: f"Inside {WHAT[i % 6].title()}\n0{i % 10}:1{i % 6}\nkm {i}\nEXIT {i}" for i in range(20)}
#: 200 keywords that all differ.
KEYWORDS = [f"{a}{b}{c}" for a in ("foto", "cine", "moto", "tele") for b in ("band", "card", "deal", "lamp", "ring") for c in ("ab", "ed", "il", "on", "ut", "ax", "er", "is", "om", "um")]
REPEATED = {
    31: " ".join(KEYWORDS[:60] * 500),
    32: ", ".join(KEYWORDS[:60] * 500),
    33: "how to watch football on tv " * 500,
    34: "the best offers for your holiday are only here today\n" * 60,
    35: "The best offers for your holiday are only here today.\n" * 60,
    36: "cheap phone and cheap tariff for phone deals with cheap phone " * 40,
    37: ", ".join(KEYWORDS),
    38: " ".join(KEYWORDS + KEYWORDS[::-1]),
    39: "Tags: " + ", ".join(["cheap tickets", "live stream", "free match", "full hd"] * 20),
    40: "\n".join(["Tags: cheap tickets live stream"] * 40),
}
INGREDIENTS = "200 g flour\n2 eggs\n100 ml milk\n1 pinch of salt\n50 g butter\n1 lemon\nfresh basil\nblack pepper\nolive oil\n"
ORDINARY = {
    51: INGREDIENTS * 2,
    52: "flour, sugar, butter, eggs, milk, salt, baking powder, vanilla, lemon zest, cinnamon, raisins, almonds. " * 2,
    53: PROSE[1_000] + "\nhttps://a.example/v/1\n#Live #Goal",
    54: " ".join(PROSE.values()),
    55: "um you can see see see see the ferry and then they all went home before it began to rain",
}


def test_spam_pages(spark):
    data = [(i, t, "en", "x", "y") for i, t in {**SPAM, **HAM, **REPEATED, **ORDINARY, **PROSE, **LISTS}.items()]
    data += [(90, None, None, "x", "y"), (91, "", "en", "x", "y"), (92, " \n\t", "en", "x", "y"), (1, SPAM[1], "vi", "x", "y"), (None, SPAM[2], None, "x", "y"), (93, "!? --- 1", "und", "x", "y")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, junk string, threshold string")
    got = sorted((r[0] for r in spam.spam_pages(df).collect()), key=repr)
    assert got == sorted([*SPAM, *REPEATED, 1, None], key=repr)
    shares = spam.spam_shares(df)
    assert shares.where("doc_id in (90, 91, 92)").isEmpty() and shares.where("doc_id = 93").collect()[0]["junk_chars"] == 0
    assert spam.spam_pages(df.limit(0)).isEmpty()
    assert spam.spam_pages(df.where("doc_id between 90 and 93")).isEmpty()


def test_function_words_are_learnt_for_any_language(spark):
    swap = str.maketrans("aeioutnhs", "eiouantsh")  # a language of its own with the same grammar
    data = [(i, t, "en") for i, t in {**PROSE, **LISTS}.items()] + [(9_000 + i, t.lower().translate(swap), "xx") for i, t in {**PROSE, **LISTS}.items()]
    df = spark.createDataFrame([*data, (1, None, None), (2, "alone", "und")], "doc_id bigint, text string, lang string")
    words = spam.function_words(df)
    assert set(words) == {"en", "xx"} and {"in", "and", "it", "so"} <= set(words["en"]) and not {"loom", "mast", "baskets", "exit"} & set(words["en"])
    assert {w.translate(swap) for w in words["en"]} <= set(words["xx"])
    strange = spark.createDataFrame([*data, (7, (REPEATED[36] + PROSE[1_000]).lower().translate(swap), None)], "doc_id bigint, text string, lang string")
    assert [tuple(r) for r in spam.spam_shares(strange).where("junk_share > 0.5").select("doc_id", "lang").collect()] == [(7, "xx")]


def test_a_very_long_page_is_judged_whole(spark):
    prose = PROSE[1_003] + "\n"
    lines = [f"{w} {v}" for w, v in zip(KEYWORDS, KEYWORDS[7:] + KEYWORDS[:7])]
    long = {1: "\n".join(f"{t}\n" for t in PROSE.values()) * 300 + SPAM[1] * 3, 2: prose * 2 + SPAM[1] * 40_000, 3: "x" * 3_000_000, 4: "\n".join(lines * 200)}
    df = spark.createDataFrame([(i, t, "en") for i, t in {**long, **PROSE, **LISTS}.items()], "doc_id bigint, text string, lang string")
    shares = {r["doc_id"]: r for r in spam.spam_shares(df).collect()}
    assert shares[2]["junk_share"] > 0.99 and shares[4]["junk_share"] == 1.0 and shares[3]["n_chars"] == 3_000_000 and shares[3]["junk_chars"] == 0
    assert shares[2]["n_chars"] > 40_000 * len(SPAM[1].replace(" ", ""))


def test_page_measures(spark):
    text = "Live goal, live goal - live goal 7\nsee the tv\nsee the tv\n\nsee the tv 3\nhttps://a.example/x y\u0065\u0301t"
    df = spark.createDataFrame([(1, text, None), (2, None, "en"), (None, "", "en")], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r.asDict() for r in spam.page_measures(df).collect()}
    assert got[1] == {
        "doc_id": 1, "n_words": 16, "n_lines": 5, "n_separators": 2, "form_chars": 19, "word_chars": 53, "top_word_n": 3, "bigram_words": 15, "trigram_words": 9, "line_words": 9,
    }
    assert set(got[2].values()) == {2, 0} and got[None]["n_words"] == 0
