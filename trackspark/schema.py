"""Column layout of the feature table and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
# These must be exactly as they are for results to agree with existing feature
# tables, models and file names; nothing here is tuned for this library.
AUDIO_SUFFIXES = (".mp3", ".wav", ".flac", ".ogg", ".m4a", ".aac")
TRANSCODE_SUFFIXES = (".m4a", ".aac", ".mp4")
SAMPLE_RATE = 44100
N_FFT = 4096
HOP_LENGTH = 1024
N_MFCC = 20
N_CHROMA_BINS = 12
N_MELS = 128
MEL_FMIN = 27.5
MEL_FMAX = 16000.0
DEFAULT_FRAME = 2048
DEFAULT_HOP = 512
DEFAULT_TEMPO = 120.0
PCM_SCALE = 32768.0
FEATURE_WEIGHTS = {
    "mfcc": 1.2,
    "chroma": 0.8,
    "tempo": 1.0,
    "spectral": 1.0,
    "default": 1.0,
}
RETAINED_VARIANCE = 0.95
OVERFETCH = 3
HISTORY_SIZE = 50
QUEUE_REQUEST = 15
QUEUE_SIZE = 10
TOP_RECOMMENDATIONS = 5
REFRESH_EVERY = 6
SAVE_EVERY = 50
NAME_PATTERN = r"(.*?)\s*-\s*(.*?)(?:\s*\(|\s*\[|\s*-\s*\d|$)"
NUMBERED_NAME_PATTERN = r"(\d+)[\s.-]*(.*?)\s*-\s*(.*?)(?:\s*\(|\s*\[|$)"
UNKNOWN_TITLE = "Unknown Title"
UNKNOWN_ARTIST = "Unknown Artist"
UNKNOWN_ALBUM = "Unknown Album"
METADATA_COLUMNS = ("file_path", "file_name", "file_extension", "file_size_mb")
UNDONE_MEASURES = ("tonic_deviation", "rhythm_regularity", "drone_likelihood")
FRAME_MEASURES = ("spectral_centroid", "spectral_bandwidth", "zero_crossing_rate", "rms")
# ----------------------------------------------------------------------------


def _stats(name: str) -> list[str]:
    return [f"{name}_mean", f"{name}_std"]


MFCC_COLUMNS = [c for i in range(1, N_MFCC + 1) for c in _stats(f"mfcc_{i}")]

# Written for table compatibility only: no chroma, beat or drone analysis is done.
PLACEHOLDERS = {
    **{c: 0.0 for i in range(1, N_CHROMA_BINS + 1) for c in _stats(f"chroma_{i}")},
    "tempo": DEFAULT_TEMPO,
    **dict.fromkeys(UNDONE_MEASURES, 0.0),
}

FEATURE_COLUMNS = (
    ["duration"]
    + [c for m in FRAME_MEASURES for c in _stats(m)]
    + MFCC_COLUMNS
    + list(PLACEHOLDERS)
)

FEATURE_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in FEATURE_COLUMNS]
    + [
        T.StructField("file_path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_extension", T.StringType()),
        T.StructField("file_size_mb", T.DoubleType()),
    ]
)
