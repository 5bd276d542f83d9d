"""Log lines on standard error and, if asked, in a file."""

from __future__ import annotations

import logging
import sys
from pathlib import Path

_FORM = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def logger(name: str, file: str | Path | None = None) -> logging.Logger:
    """A logger with one handler for each place, however often it is asked for."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    log.propagate = False
    places = {getattr(h, "baseFilename", "") for h in log.handlers}
    if "" not in places:
        log.addHandler(logging.StreamHandler(sys.stderr))
    if file is not None and str(Path(file).resolve()) not in places:
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        log.addHandler(logging.FileHandler(Path(file).resolve()))
    for h in log.handlers:
        h.setFormatter(logging.Formatter(_FORM))
    return log
