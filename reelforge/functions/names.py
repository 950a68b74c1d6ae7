"""Feature-name builders (L5) and allowed-name lists.

The names are the column names of the feature tables, so they must equal the
original ones; long lists are produced from their rule, short irregular ones
are written out as fixed values.
"""

from __future__ import annotations

from reelforge.functions.scalar import CATEGORY_NAMES, SUPER_CATEGORY_NAMES

# ---------------------------------------------------------------- fixed values
# Short-term audio features, in extractor order.
AUDIO_SHORT_TERM = (["zcr", "energy", "energy_entropy", "spectral_centroid", "spectral_spread",
                     "spectral_entropy", "spectral_flux", "spectral_rolloff"]
                    + [f"mfcc_{i}" for i in range(1, 14)] + [f"chroma_{i}" for i in range(1, 13)] + ["chroma_std"])
# Symbolic features kept by the extractor, in order.
SYMBOLIC_FEATURES = [
    "AverageMelodicIntervalFeature", "MostCommonMelodicIntervalFeature",
    "DistanceBetweenMostCommonMelodicIntervalsFeature", "MostCommonMelodicIntervalPrevalenceFeature",
    "RelativeStrengthOfMostCommonIntervalsFeature", "NumberOfCommonMelodicIntervalsFeature",
    "AmountOfArpeggiationFeature", "RepeatedNotesFeature", "ChromaticMotionFeature", "StepwiseMotionFeature",
    "MelodicThirdsFeature", "MelodicFifthsFeature", "MelodicTritonesFeature", "MelodicOctavesFeature",
    "DirectionOfMotionFeature", "DurationOfMelodicArcsFeature", "SizeOfMelodicArcsFeature",
    "MostCommonPitchPrevalenceFeature", "MostCommonPitchClassPrevalenceFeature",
    "RelativeStrengthOfTopPitchesFeature", "RelativeStrengthOfTopPitchClassesFeature",
    "IntervalBetweenStrongestPitchesFeature", "IntervalBetweenStrongestPitchClassesFeature",
    "NumberOfCommonPitchesFeature", "PitchVarietyFeature", "PitchClassVarietyFeature", "RangeFeature",
    "MostCommonPitchFeature", "PrimaryRegisterFeature", "ImportanceOfBassRegisterFeature",
    "ImportanceOfMiddleRegisterFeature", "ImportanceOfHighRegisterFeature", "MostCommonPitchClassFeature",
    "NoteDensityFeature", "AverageNoteDurationFeature", "VariabilityOfNoteDurationFeature",
    "MaximumNoteDurationFeature", "MinimumNoteDurationFeature", "StaccatoIncidenceFeature",
    "AverageTimeBetweenAttacksFeature", "VariabilityOfTimeBetweenAttacksFeature",
    "AverageTimeBetweenAttacksForEachVoiceFeature",
    "AverageVariabilityOfTimeBetweenAttacksForEachVoiceFeature", "InitialTempoFeature",
    "InitialTimeSignatureFeature", "CompoundOrSimpleMeterFeature", "TripleMeterFeature",
    "QuintupleMeterFeature", "ChangesOfMeterFeature", "DurationFeature",
    "MaximumNumberOfIndependentVoicesFeature", "AverageNumberOfIndependentVoicesFeature",
    "VariabilityOfNumberOfIndependentVoicesFeature", "QualityFeature", "TonalCertainty",
    "UniqueNoteQuarterLengths", "MostCommonNoteQuarterLength", "MostCommonNoteQuarterLengthPrevalence",
    "RangeOfNoteQuarterLengths", "UniquePitchClassSetSimultaneities", "UniqueSetClassSimultaneities",
    "MostCommonPitchClassSetSimultaneityPrevalence", "MostCommonSetClassSimultaneityPrevalence",
    "MajorTriadSimultaneityPrevalence", "MinorTriadSimultaneityPrevalence",
    "DominantSeventhSimultaneityPrevalence", "DiminishedTriadSimultaneityPrevalence",
    "TriadSimultaneityPrevalence", "DiminishedSeventhSimultaneityPrevalence",
    "IncorrectlySpelledTriadPrevalence", "ComposerPopularity", "LandiniCadence", "LanguageFeature",
]
# Symbolic features that need a web lookup, lyrics or spelled notation: null columns.
SYMBOLIC_NOT_BUILT = ["IncorrectlySpelledTriadPrevalence", "ComposerPopularity", "LandiniCadence", "LanguageFeature"]
# Visual per-frame features: histogram name and bin count, then the scalar ones.
VISUAL_HISTOGRAMS = [("hist_r", 8), ("hist_g", 8), ("hist_b", 8), ("hist_v", 8), ("hist_rgb", 5), ("hist_s", 8)]
VISUAL_MODE2 = ["frontal_faces_num", "fronatl_faces_ratio", "tilt_pan_confidences", "mag_mean", "mag_std",
                "shot_durations"]
VISUAL_STATS = ["mean_", "std_", "stdmean_", "mean10top_"]
# --------------------------------------------------------------------------------


def audio_feature_names() -> list[str]:
    """138 audio feature columns: (features, delta features) x (mean, std), then beat."""
    base = AUDIO_SHORT_TERM + [f"delta {n}" for n in AUDIO_SHORT_TERM]
    return [f"{n}_mean" for n in base] + [f"{n}_std" for n in base] + ["beat", "beat_conf"]


def visual_feature_names(process_mode: int, which_object_categories: int = 0) -> tuple[list[str], list[str]]:
    """(per-frame names, per-video statistic names) for a process mode
    (1 colour, 2 + faces / flow / shots, 3 + objects) and a category level
    (0: 80 labels, otherwise 12 super categories)."""
    if process_mode not in (1, 2, 3):
        raise ValueError("process_mode must be 1, 2 or 3")
    frame = [f"{h}{i}" for h, n in VISUAL_HISTOGRAMS for i in range(n)] + ["frame_value_diff"]
    if process_mode > 1:
        frame += VISUAL_MODE2
    stats = [p + n for p in VISUAL_STATS for n in frame]
    if process_mode == 3:
        cats = SUPER_CATEGORY_NAMES if which_object_categories > 0 else CATEGORY_NAMES
        for suffix, stat in (("_num", "_freq"), ("_confidence", "_mean_confidence"),
                             ("_area_ratio", "_mean_area_ratio")):
            frame += [c + suffix for c in cats]
            stats += [c + stat for c in cats]
    return frame, stats


def symbolic_feature_names(drop: str | None = None) -> list[str]:
    """the allowed symbolic feature names (optionally with one excluded)."""
    return [n for n in SYMBOLIC_FEATURES if n != drop]
