"""Values that must stay fixed for results to agree with existing tables."""

# Label names stored in the tables.
POSITIVE = "PKS"
NEGATIVE = "non-PKS"
SOURCES = ("PKS", "bio", "chem")
SPLITS = ("train", "val", "test")

# Fingerprint settings, split settings and their seed.
N_BITS = 2048
RADIUS = 2
SEED = 42
HOLDOUT_FRACTION = 0.2
MIN_PER_CLASS = 10
RATIO_TOLERANCE = 0.05

# Characters that carry stereo marks.
FORBIDDEN_CHARACTERS = ("@", "/", "\\")

# Products dropped after release.
RELEASE_EXCLUDED = ("S", "O=C=O")

# Helper molecules dropped after one-step expansion.
HELPER_VALUES = (
    "O", "O=O", "[H][H]", "O=C=O", "C=O", "[C-]#[O+]", "Br", "[Br][Br]", "CO", "C=C",
    "O=S(O)O", "N", "O=S(=O)(O)O", "O=NO", "N#N", "O=[N+]([O-])O", "NO", "C#N", "S", "O=S=O",
)

# File names of the split tables.
SPLIT_FILE = "{base}/{split}/baseline_{split}{suffix}.{ext}"
FINGERPRINT_SUFFIX = "_ecfp4"
