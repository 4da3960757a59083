"""Every operator as a runnable query over the event table, with its SQL equivalent."""
