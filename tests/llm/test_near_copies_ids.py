"""The pipeline's near-dedup stage with null and repeated ids."""

from test_near_copies import kept, words


def test_null_and_repeated_ids_of_unrelated_texts_stay(spark):
    rows = [(None, " ".join(words(i))) for i in range(5)] + [(7, " ".join(words(i))) for i in range(5, 9)]
    assert set(kept(spark, rows)) == set(rows) and kept(spark, rows + rows).total() == len(rows)


def test_an_id_goes_before_null(spark):
    text = " ".join(words(1))
    assert kept(spark, [(None, text), (9, text), (8, text.upper())]).total() == 1
    assert set(kept(spark, [(None, text), (9, text), (8, text.upper())])) == {(8, text.upper())}
