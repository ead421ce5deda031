import sys

from cellweave.cli import main

sys.exit(main())
