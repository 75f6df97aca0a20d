import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

from edge import docs, none  # noqa: E402, F401
