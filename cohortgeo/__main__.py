"""python -m cohortgeo."""

import sys

from cohortgeo.cli import main

sys.exit(main())
