import sys

from codestrata.cli import main

sys.exit(main())
