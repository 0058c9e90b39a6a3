"""python -m pathloom"""

import sys

from pathloom.cli import main

sys.exit(main())
