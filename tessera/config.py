"""Parameters for every job, as frozen dataclasses.

Operators take one of these instead of reading module globals, so two jobs with
different thresholds can share one Spark session.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. These must equal the reference's settings for results to match:
# quality thresholds, generated-file markers, block length, budget, split
# fraction, seeds, special ids, prompt template markers and evaluation prompts.
# ---------------------------------------------------------------------------
MIN_CHARS = 200
MAX_CHARS = 80_000
MIN_LINES = 8
MIN_AVG_LINE = 10
MAX_AVG_LINE = 200
MIN_ALNUM_RATIO = 0.20
AUTOGEN_MARKERS = ("auto-generated", "do not edit", "generated by", "pb2.py")
HEADER_CHARS = 1024
STRUCTURE_MARKERS = ("def ", "class ")

BLOCK = 1024
TARGET_TOKENS = 3_000_000_000
VAL_FRACTION = 0.005
DATA_SEED = 42
PROGRESS_EVERY_CHUNKS = 100_000
VOCAB_SIZE = 49152
EOS_ID = 0
IGNORE_INDEX = -100
PAD_ID = 0

PER_DEVICE_BATCH = 4
GRAD_ACCUM_STEPS = 32
MAX_STEPS = 35_390
LR_INIT = 3e-4
LR_MIN = 3e-5
WARMUP_STEPS = 2000
GRAD_SKIP_THRESHOLD = 100.0
EVAL_MAX_BATCHES = 200

SFT_VAL_FRACTION = 0.05
SFT_SEED = 42
SFT_EPOCHS = 3
SFT_BATCH_SIZE = 2
SFT_GRAD_ACCUM = 16
SFT_MAX_SEQ_LEN = 512
SFT_MIN_TOKENS = 10

INSTRUCTION_HEADER = "### Instruction:\n"
INPUT_HEADER = "### Input:\n"
RESPONSE_MARKER = "### Response:\n"
COMPLETION_CUT = "### Instruction:"

CODE_PROMPTS = (
    'def fibonacci(n):\n    """Return nth Fibonacci number."""\n',
    'def is_palindrome(s: str) -> bool:\n    """Check if string is palindrome."""\n',
    'def two_sum(nums, target):\n    """Find two indices that sum to target."""\n',
    'class Stack:\n    """LIFO stack implementation."""\n    def __init__(self):\n',
    "def binary_search(arr, target):\n    left, right = 0, len(arr) - 1\n",
)
INSTRUCTION_PROMPTS = (
    "### Instruction:\nWrite a Python function that takes a list of numbers and returns the largest one.\n\n### Response:\n",
    "### Instruction:\nWrite a Python function to reverse a string.\n\n### Response:\n",
    "### Instruction:\nWrite a Python function to check if a number is prime.\n\n### Response:\n",
    "### Instruction:\nWrite a Python class that represents a simple calculator with add, subtract, multiply, and divide methods.\n\n### Response:\n",
    "### Instruction:\nWrite a Python function that takes a list of strings and returns only those that are palindromes.\n\n### Response:\n",
)
# ---------------------------------------------------------------------------

PROFILES = ("code", "prose")


@dataclass(frozen=True)
class QualityConfig:
    """Thresholds of the corpus filter. Bounds are inclusive.

    ``profile="code"`` applies every rule; ``"prose"`` skips the structure and
    syntax rules, for corpora that are not source code.
    """

    min_chars: int = MIN_CHARS
    max_chars: int = MAX_CHARS
    min_lines: int = MIN_LINES
    min_avg_line: float = MIN_AVG_LINE
    max_avg_line: float = MAX_AVG_LINE
    min_alnum_ratio: float = MIN_ALNUM_RATIO
    autogen_markers: tuple[str, ...] = AUTOGEN_MARKERS
    header_chars: int = HEADER_CHARS
    structure_markers: tuple[str, ...] = STRUCTURE_MARKERS
    profile: str = "code"

    def __post_init__(self):
        if self.profile not in PROFILES:
            raise ValueError(f"profile must be one of {PROFILES}, got {self.profile!r}")

    @property
    def check_structure(self) -> bool:
        return self.profile == "code"

    @property
    def check_syntax(self) -> bool:
        return self.profile == "code"


@dataclass(frozen=True)
class PackConfig:
    block: int = BLOCK
    target_tokens: int | None = None  # K6 only where a caller asks for it (TARGET_TOKENS is the reference's)
    val_fraction: float = VAL_FRACTION
    seed: int = DATA_SEED
    progress_every: int = PROGRESS_EVERY_CHUNKS
    # Order buckets of the two-level prefix sum hold about ``rows_per_bucket`` rows or
    # ``bucket_bytes`` of tokens, whichever is less, and there is at least one per task
    # slot. ``max_buckets`` is a ceiling for callers that want one.
    max_buckets: int | None = None
    rows_per_bucket: int = 1_000_000
    bucket_bytes: int = 64 * 1024 * 1024


@dataclass(frozen=True)
class SftConfig:
    max_len: int = SFT_MAX_SEQ_LEN
    min_tokens: int = SFT_MIN_TOKENS
    val_fraction: float = SFT_VAL_FRACTION
    seed: int = SFT_SEED
    batch_size: int = SFT_BATCH_SIZE
    grad_accum: int = SFT_GRAD_ACCUM
    epochs: int = SFT_EPOCHS


@dataclass(frozen=True)
class TrainConfig:
    batch_size: int = PER_DEVICE_BATCH
    grad_accum: int = GRAD_ACCUM_STEPS
    max_steps: int = MAX_STEPS
    context: int = BLOCK
    seed: int = DATA_SEED
    drop_last: bool = True
    carry_groups_across_epochs: bool = True
    grad_skip_threshold: float = GRAD_SKIP_THRESHOLD
    lr_init: float = LR_INIT
    lr_min: float = LR_MIN
    warmup_steps: int = WARMUP_STEPS

    @property
    def effective_batch(self) -> int:
        return self.batch_size * self.grad_accum


@dataclass(frozen=True)
class EvalConfig:
    max_batches: int | None = EVAL_MAX_BATCHES
    batch_size: int = PER_DEVICE_BATCH
    cut_marker: str = COMPLETION_CUT
    code_prompts: tuple[str, ...] = field(default=CODE_PROMPTS)
    instruction_prompts: tuple[str, ...] = field(default=INSTRUCTION_PROMPTS)
