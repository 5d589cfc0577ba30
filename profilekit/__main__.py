"""python -m profilekit"""

import sys

from profilekit.cli import main

sys.exit(main())
