"""Puts the repository on the path of tests and of their Python workers."""

import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
