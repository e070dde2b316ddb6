from .plans.commands import main

raise SystemExit(main())
