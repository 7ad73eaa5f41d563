from tessera.llm.quality_rules import BASE, RULES, Cascade, Figures, measure, n_repeat_words, ordered

CLEAN = "Many quiet words make up this ordinary line of prose, and none of them repeats itself in any odd way."
TEXTS = [None, "", " \n ", CLEAN, "a b c d e " * 9, "# | # | # | " + CLEAN, "\n".join(["one line that comes again", "x y z", *["one line that comes again"] * 4]), "w" * 100000, CLEAN, "1234 567 89 " * 3 + CLEAN[:20] + " 1 22 333 4444 55 66", "\n".join(f"- item {i} of a list that is long" for i in range(9)), "\n".join(f"so it went on and on {i}..." for i in range(5))]


def brute_repeats(text):
    w = text.split()
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    return len({i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)})


def test_repeat_words_against_brute_force():
    for t in ["a b c d e a b c d e f", "a a a a a a a", CLEAN, "x " * 4, "a b c d e f a b c d e a b c d e f"]:
        assert n_repeat_words(Figures(t)) == brute_repeats(t)


def test_verdict_does_not_depend_on_the_order(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, CLEAN, "x")], "doc_id bigint, text string, kept string")
    forward = {r.doc_id: r.kept for r in Cascade().apply(df).collect()}
    backward = {r.doc_id: r.kept for r in Cascade((*RULES[::-1], BASE)).apply(df).collect()}
    planned = Cascade().planned(df)
    assert forward == backward == {r.doc_id: r.kept for r in planned.apply(df, figures=True).collect()}
    assert forward == {0: False, 1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: False, 8: True, 9: False, 10: False, 11: False, None: True}
    assert sorted(r.text for r in planned.filter(df).collect()) == [CLEAN] * 3
    assert Cascade().planned(df.limit(0)).apply(df.limit(0)).count() == 0


def test_order_is_by_rejection_per_cost():
    scores = [m.score for m in ordered((BASE, *RULES), measure(TEXTS * 20, (BASE, *RULES)))]
    assert scores == sorted(scores, reverse=True) and len(scores) == 7


def test_later_rules_are_not_run():
    f = Figures("too short")
    assert Cascade((BASE, *RULES)).first_rejection(f) == "base" and set(f.cache) == {"n_words"}
    f = Figures("# | # | # | " + CLEAN)
    assert Cascade((BASE, *RULES)).first_rejection(f) == "symbols" and "n_letter_words" not in f.cache


def test_the_sample_is_spread_over_the_table_and_stays_in_the_executors(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('text number ', id, ' of many') AS text").repartition(8, "doc_id")
    assert len(Cascade().planned(df, sample_rows=50).rules) == 7
    same = spark.range(4000).selectExpr("id AS doc_id", "'all alike' AS text")
    assert len(Cascade().planned(same, sample_rows=50).rules) == 7
