"""Loggers: one handler each, to the console and, if asked for, to a file."""

from __future__ import annotations

import logging
from pathlib import Path


def get_logger(name: str, level: str = "INFO", folder: str | None = None) -> logging.Logger:
    log = logging.getLogger(name)
    log.setLevel(level)
    if not log.handlers:
        form = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
        handlers: list[logging.Handler] = [logging.StreamHandler()]
        if folder:
            Path(folder).mkdir(parents=True, exist_ok=True)
            handlers.append(logging.FileHandler(Path(folder) / f"{name}.log", encoding="utf-8"))
        for h in handlers:
            h.setFormatter(form)
            log.addHandler(h)
    return log
