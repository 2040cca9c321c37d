"""Publishing a finished tileset file. publish() makes local copies and says what other backends are to run; publish_now() runs that too."""

from __future__ import annotations

import shutil
import subprocess
from pathlib import Path

from ..config import Publish


def publish_local(path: str, destination: str) -> str:
    """Copies a file to a path or into a folder; makes the folders that lack."""
    target = Path(destination)
    if target.is_dir() or destination.endswith("/"):
        target = target / Path(path).name
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.copy2(path, target)
    return str(target)


def publish(path: str, settings: Publish, reason: str) -> list[str] | str | None:
    """Publishes after `reason` (generate or update), if the settings say so. Remote backends give back the command to run."""
    if problems := settings.problems():
        raise ValueError("; ".join(problems))
    if settings.backend == "none" or not (settings.on_generate if reason == "generate" else settings.on_update):
        return None
    if settings.backend == "local":
        return publish_local(path, settings.destination)
    if settings.backend == "s3":
        return ["aws", "s3", "cp", path, settings.destination, *settings.args]
    if settings.backend == "command":
        return ["sh", "-c", settings.command]
    raise NotImplementedError(f"no network here for publish backend {settings.backend}")


def publish_now(path: str, settings: Publish, reason: str) -> None:
    """Publishes, by the backend's command where there is one; a command that fails raises."""
    if isinstance(command := publish(path, settings, reason), list):
        subprocess.run(command, check=True)
