"""Job parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

# The image sizes and quality that file names may carry.
IMAGE_SIZES = ((600, 800), (640, 960), (1236, 1648))
DEFAULT_IMAGE_QUALITY = 40

# Button captions that are not comment text, and the caption
# after which the next text is an author again.
COMMENT_NOISE = ("Odpowiedz", "Usuń")
COMMENT_RESET = "Usuń"


@dataclass(frozen=True)
class JobConfig:
    """Parameters of one run; ``limit`` and ``skip`` stay strings.

    A limit counts only when it is all digits, a skip only when it reads as a
    positive integer. ``as_of`` stands in for "now" and ``accessed_at`` is the
    access time printed in chapters, so that reruns give the same rows.
    """

    language: str = "en"
    include_images: bool = True
    images_size: tuple[int, int] = IMAGE_SIZES[0]
    images_quality: int = DEFAULT_IMAGE_QUALITY
    images_bw: bool = True
    limit: str = ""
    skip: str = ""
    comment_noise: tuple[str, ...] = COMMENT_NOISE
    comment_reset: str = COMMENT_RESET
    as_of: datetime = field(default=datetime(2024, 1, 31, tzinfo=timezone.utc))
    accessed_at: datetime = field(default=datetime(2024, 1, 31, tzinfo=timezone.utc))
