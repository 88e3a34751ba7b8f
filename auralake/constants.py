"""Metric names, features, tolerances and texts that results depend on."""

# metric name -> fingerprint feature (fixed values)
FEATURES = {
    "SNR": "noise.snr",
    "Estimated SNR": "noise.snr",
    "Integrated Loudness (LUFS)": "loudness.integrated_lufs",
    "True Peak": "loudness.true_peak",
    "DNSMOS OVRL": "perceptual.dnsmos_ovrl",
    "DNSMOS P.835 OVRL": "perceptual.dnsmos_ovrl",
    "DNSMOS P.835 OVRL (proxy)": "perceptual.dnsmos_ovrl",
    "P.563 Proxy (NB Quality Estimate)": "perceptual.p563_proxy",
    "Spectral Centroid": "spectral.centroid",
    "Zero Crossing Rate": "temporal.zcr",
    "Clipping Ratio": "noise.clipping_ratio",
    "Harmonic-to-Noise Ratio": "speech.hnr",
    "Harmonic-to-Noise Ratio (HNR)": "speech.hnr",
    "F0 Mean": "prosody.f0_mean",
}

# which way is better (fixed values); features not named have no better direction
DIRECTION = {
    "noise.snr": "higher",
    "speech.hnr": "higher",
    "perceptual.dnsmos_ovrl": "higher",
    "perceptual.p563_proxy": "higher",
    "loudness.true_peak": "lower",
    "noise.clipping_ratio": "lower",
}

# smallest change worth reporting (fixed values): absolute, or as a share of the reference value
ABSOLUTE_TOLERANCE = {
    "noise.snr": 3.0,
    "loudness.integrated_lufs": 3.0,
    "loudness.true_peak": 1.0,
    "speech.hnr": 3.0,
    "perceptual.dnsmos_ovrl": 0.35,
    "perceptual.p563_proxy": 0.35,
    "noise.clipping_ratio": 0.001,
}
RELATIVE_TOLERANCE = {"spectral.centroid": 0.10, "prosody.f0_mean": 0.10, "temporal.zcr": 0.15}

# label thresholds by preset (fixed values); None is the default
LABEL_THRESHOLDS = {
    None: {"snr_min": 15.0, "snr_fail": 10.0, "lufs_min": -23.0, "lufs_max": -10.0},
    "podcast": {"snr_min": 15.0, "snr_fail": 10.0, "lufs_min": -18.0, "lufs_max": -14.0},
    "call-center-qa": {"snr_min": 12.0, "snr_fail": 8.0, "lufs_min": -23.0, "lufs_max": -10.0},
    "speech-enhancement": {"snr_min": 15.0, "snr_fail": 12.0, "lufs_min": -23.0, "lufs_max": -10.0},
    "music-mastering": {"snr_min": 15.0, "snr_fail": 10.0, "lufs_min": -16.0, "lufs_max": -8.0},
}

# advice by label (fixed texts)
SUGGESTIONS = {
    "noisy_floor": "Run denoise or improve gain staging before downstream speech analysis.",
    "clipping_risk": "Lower input gain or re-export with true-peak limiting below -1 dBTP.",
    "hard_clipping": "Re-record if possible; otherwise use declipping before normalization.",
    "under_loud": "Normalize toward the target preset before publishing or comparing.",
    "over_loud": "Reduce program loudness and check limiter settings.",
    "low_perceptual_quality": "Inspect codec, noise, and speech enhancement stages before accepting the file.",
    "silence_heavy": "Trim leading/trailing silence or verify the file is the intended recording.",
    "dropouts": "Check the capture/transmission chain for buffer underruns or packet loss; re-record or conceal the gaps.",
}

# groups that need speech, audio suffixes and split names (fixed values)
SPEECH_GROUPS = ("speech", "prosody", "speaker")
SUPPORTED_SUFFIXES = (".wav", ".mp3", ".flac", ".ogg", ".m4a", ".aac", ".opus", ".wma", ".aiff", ".aif", ".mp4", ".webm")
SPLIT_NAMES = ("train", "validation", "test", "val")
