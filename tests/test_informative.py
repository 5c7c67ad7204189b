"""The most informative code does not hang on the last bits of a mean."""

from attestor.operators import selective

CURVE = "code_id string, point int, kappa double"


def test_gains_equal_but_for_noise_are_a_tie(spark):
    # gains of 3e-16, 0 and a loss; then gains that differ in the sixth digit
    for gains, want in (({"b": 3e-16, "a": 0.0, "c": -0.2}, ("a", 0.0)), ({"b": 0.300002, "a": 0.300001}, ("b", 0.300002))):
        random = spark.createDataFrame([(c, p, 0.25) for c in gains for p in (0, 1)], CURVE)
        curve = spark.createDataFrame([(c, p, 0.25 + (g if p else 0)) for c, g in gains.items() for p in (0, 1)], CURVE)
        assert selective.most_informative(curve, random).collect() == [want]
