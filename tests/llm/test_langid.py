import os
import random
import string

import pytest

from fieldloom.llm import langid as x

VOCAB = {"en": "the of and to in is that for was with this have from they", "de": "der die und das nicht ein ist mit für auf über schön wird auch", "fr": "le la les des été qui que dans pour avec être où même aussi"}


def table(spark, n=360):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = rng.choice(list(VOCAB))
        rows.append((i, " ".join(rng.choices(VOCAB[lang].split(), k=rng.randint(3, 60))), lang if i % 11 else None, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy(spark):
    df = table(spark)
    truth = {r.doc_id: r.score for r in df.collect()}
    got = x.identify(df).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 360 and 60 < len(held) < 180
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and not any(r.rejected for r in got)


def test_labels_of_the_held_out_fold_are_not_used(spark):
    from pyspark.sql import functions as F

    df = table(spark)
    fold = x.fold(df, 3)
    other = df.withColumn("lang", F.when(fold == 1, F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(str, x.identify(df).collect())) == sorted(map(str, x.identify(other).collect()))


def test_odd_rows(odd, odd_rows, none):
    got = x.identify(odd).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    for i in (200, 201, 202, 203):
        assert by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0
    assert by[204].lang_pred in ("en", "de")
    kept = x.keep_identified(odd)
    assert kept.columns == odd.columns and kept.where("doc_id between 200 and 203").isEmpty()
    assert kept.where("doc_id < 140").count() == odd.where("doc_id < 140").count()
    assert x.identify(none).collect() == [] and x.keep_identified(none).collect() == []


def test_counts_see_whole_texts():
    import numpy as np
    import pyarrow as pa

    a, b = "x" * 50_000 + "ab", "ab"
    one = next(x.counts(pa.array([a, b, None, "Ab"], pa.string())))
    assert one[0].sum() > 100_000 and np.array_equal(one[1], one[3]) and one[2].sum() <= 1


def test_one_rejected_row_takes_no_other_along(spark):
    from pyspark.sql import functions as F

    df = table(spark).withColumn("doc_id", F.when(F.col("doc_id") < 180, F.col("doc_id"))).cache()
    junk = spark.createDataFrame([(None, "12 34 !!", "en", ""), (200, "...", "de", ""), (None, None, None, None)], df.schema)
    kept = x.keep_identified(df.union(junk))
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))


def test_sample_of_copies_and_huge_counts(spark):
    """A language of copies alone is fitted, copies fill no places, and a text with over 65,504 equal n-grams spoils nothing."""
    from pyspark.sql import functions as F

    df = table(spark)
    copies = spark.range(1000, 1000 + 3 * x.SAMPLE).select("id", F.lit("ett och det som en av för med").alias("text"), F.lit("sv").alias("lang"), F.lit("sv").alias("score"))
    huge = spark.createDataFrame([(5000, "der " * 70_000, "de", "de")], df.schema)
    docs = df.union(copies).union(huge)
    model = x.fit(docs, F.lit(True))
    assert model.langs == ["de", "en", "fr", "sv"] and len(set(model.lang_of.tolist())) == 4 and bool((model.centroids == model.centroids).all())
    got = {r.doc_id: r.lang_pred for r in x.predict(docs, model).collect()}
    assert all(got[r.doc_id] == r.score for r in docs.where("score = 'sv'").collect()) and len(set(got.values())) == 4
    chosen, sizes = x._sample(docs.where("lang is not null"))
    assert sizes["sv"] == 3 * x.SAMPLE and chosen.where("lang = 'sv'").count() == 1


def test_small_language_of_many_is_fitted(spark):
    from pyspark.sql import functions as F

    few = " ".join(f"w{i}" for i in range(9))
    big = spark.range(2 * x.SAMPLE * 4).select("id", F.concat(F.lit("the of and "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    for i in range(6):
        big = big.union(spark.range(90000 + 1000 * i, 90000 + 1000 * i + 1 + 899 * (i == 0)).select("id", F.lit(f"{few} {'x' * i}").alias("text"), F.lit("zz").alias("lang")))
    chosen, sizes = x._sample(big.select(F.col("id").alias("doc_id"), "text", "lang"))
    assert {r.lang: r["count"] for r in chosen.groupBy("lang").count().collect()} == {"en": x.SAMPLE, "zz": 6}


JUNK = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_foreign_and_random_texts_go_and_clean_ones_stay(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").cache()
    model = x.fit(docs, x.fold(docs, 3) != 1)
    rng = random.Random(6)
    some = lambda n, alphabet: "".join(rng.choices(alphabet, k=n))
    junk = [t * k for t in JUNK.values() for k in (1, 3, 20)]
    junk += [some(n, a) for n in (200, 2000, 20000) for a in (string.ascii_letters + "   ", string.ascii_letters + string.digits + "+/", "0123456789abcdef")]
    got = x.predict(spark.createDataFrame(list(enumerate(junk)), "doc_id long, text string"), model).collect()
    assert [junk[r.doc_id][:40] for r in got if not r.rejected] == []
    held = docs.where((x.fold(docs, 3) == 1) & F.col("text").rlike(r"\p{L}"))
    assert x.predict(held, model).where("rejected").count() <= 0.01 * held.count()


def plain_counts(text):
    """Buckets of hashed n-grams, one at a time."""
    line = [32]
    for b in text.lower().encode():
        b = b if b >= 128 or 97 <= b <= 122 else 32
        if b != 32 or line[-1] != 32:
            line.append(b)
    out = {}
    for k in x.GRAMS:
        for i in range(len(line) - k + 1):
            h = 0
            for b in line[i : i + k]:
                h = (h * 0x01000193 + b + 1) & 0xFFFFFFFF
            bucket = ((h * int(x._ODD[k - 1])) & 0xFFFFFFFF) >> 20
            out[bucket] = out.get(bucket, 0) + 1
    return out


def test_nearest_centroid_matches_brute_force(spark):
    """Predictions against a loop over texts, n-grams and centroids in plain Python."""
    import math

    df = table(spark, 150)
    model = x.fit(df, x.fold(df, 3) != 1)
    got = {r.doc_id: r for r in x.predict(df, model).collect()}
    for r in df.collect():
        v = {b: math.log1p(n) * float(model.idf[b]) for b, n in plain_counts(r.text).items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        near = [sum(w * float(c[b]) for b, w in v.items()) / norm for c in model.centroids]
        best = max(range(len(near)), key=near.__getitem__)
        assert got[r.doc_id].lang_pred == model.langs[model.lang_of[best]] and got[r.doc_id].score == pytest.approx(min(1.0, near[best]), abs=1e-4)
    # the idf counts every training text
    train = [r for r in df.where(x.fold(df, 3) != 1).collect() if r.lang is not None]
    sets = [set(plain_counts(r.text)) for r in train]
    for b in random.Random(1).sample(sorted(set().union(*sets)), 50):
        assert float(model.idf[b]) == pytest.approx(math.log((1 + len(sets)) / (1 + sum(b in s for s in sets))) + 1, abs=1e-4)
