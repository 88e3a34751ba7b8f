"""Task presets: metric groups and threshold rules (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RULE_SCHEMA = "rule_id int, metric string, grp string, low double, high double, equals double, require_present boolean, message string"

PRESETS = {
    "podcast": {
        "groups": ("basic", "loudness", "speech", "perceptual"),
        "rules": [
            ("Integrated Loudness (LUFS)", "loudness", -18.0, -14.0, "Podcast loudness should usually land between -18 and -14 LUFS."),
            ("True Peak", "loudness", None, -1.0, "Podcast true peak should stay at or below -1 dBTP."),
            ("Active Speech Level (ASL)", "speech", -30.0, None, "Active speech level is very low for spoken-word material."),
        ],
    },
    "call-center-qa": {
        "groups": ("basic", "loudness", "temporal", "noise", "speech", "prosody", "speaker", "perceptual"),
        "rules": [
            ("Estimated SNR", "noise", 12.0, None, "Estimated SNR is low for call-review workflows."),
            ("Speech/Activity Ratio", "temporal", 25.0, None, "Speech activity is unusually sparse for a call recording."),
            ("True Peak", "loudness", None, -1.0, "Call recordings should avoid hard limiting above -1 dBTP."),
        ],
    },
    "speech-enhancement": {
        "groups": ("basic", "loudness", "noise", "speech", "perceptual", "prosody"),
        "rules": [
            ("Estimated SNR", "noise", 15.0, None, "Enhanced speech still has a low estimated SNR."),
            ("Harmonic-to-Noise Ratio (HNR)", "noise", 5.0, None, "HNR remains low after enhancement."),
            ("P.563 Proxy (NB Quality Estimate)", "perceptual", 2.5, None, "Single-ended perceptual quality remains weak after enhancement."),
        ],
    },
    "music-mastering": {
        "groups": ("basic", "loudness", "spectral", "temporal", "psychoacoustic", "perceptual"),
        "rules": [
            ("Integrated Loudness (LUFS)", "loudness", -16.0, -8.0, "Integrated loudness sits outside the usual modern mastering band."),
            ("True Peak", "loudness", None, -1.0, "Mastered deliverables should usually stay at or below -1 dBTP."),
            ("Loudness Range (LRA)", "loudness", None, 12.0, "Loudness range is unusually wide for a mastered deliverable."),
        ],
    },
}


def rules_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """Rules as a small table; each is (metric, group, low, high, message) or the same with equals and require_present before the message."""
    rows = []
    for k, r in enumerate(rules):
        metric, grp, low, high, *more = r
        equals, required, message = (None, False, *more) if len(more) == 1 else more
        rows.append((k, metric, grp, low, high, equals, required, message))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def preset_rules(spark: SparkSession, name: str) -> DataFrame:
    """The rules of a built-in preset; an unknown name is an error that lists the known ones."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; choose from {sorted(PRESETS)}")
    return rules_table(spark, PRESETS[name]["rules"])
