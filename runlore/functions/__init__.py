"""Pure Column functions, and the few Arrow functions that built-ins cannot express."""
