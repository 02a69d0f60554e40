"""Format ranges above a megahertz."""

from cadencekit.operators.catalog import match_format


def test_ranges_above_a_megahertz(spark):
    formats = spark.createDataFrame([(1, 0, 64, 64, 1.0, 60.0), (1, 1, 64, 64, 0.5, 2.5e6), (1, 2, 64, 64, 3e9, 4e12)],
                                    "device_id long, format_idx int, width int, height int, lo double, hi double")
    rates = [50.0, 100.0, 1.2e6, 2.4e6, 2.6e6, 2.9e9, 3.1e9, 3.9e12, 4.1e12]
    asked = spark.createDataFrame([(1, r, 0) for r in rates], "device_id long, rate double, format_idx int")
    got = {r.rate: (r.chosen_idx, r.supported) for r in match_format(asked, formats).collect()}
    assert [got[r] for r in rates] == [(0, True), (1, True), (1, True), (1, True), (0, False), (0, False), (2, True), (2, True), (0, False)]
